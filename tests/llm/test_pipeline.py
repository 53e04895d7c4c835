"""The pipeline against plain versions of its stages."""

from collections import Counter

import public_tokenizers
from compare import DATA
from test_simhash import closure, plain_fingerprint

import corpus_pipeline
from mnemara.llm import langid, mixing, nbest, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_run_against_plain_stages(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    lost = {r["doc_id"] for r in langid.identify_documents(docs, docs).where("rejected").collect()}
    assert not lost
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = {i: r for i, r in rows.items() if model.score(toxicity.Terms(model.terms).find(r["text"]))[0] < toxicity.THRESHOLD}
    fps = {i: plain_fingerprint(r["text"]) for i, r in clean.items()}
    group, least = closure(set(fps.values())), {}
    for i, f in fps.items():
        least[group[f]] = min(i, least.get(group[f], i))
    one = {i: r for i, r in clean.items() if least[group[fps[i]]] == i}
    sized = spark.createDataFrame([(i, r["source"], len(r["text"].encode().split())) for i, r in one.items()], "doc_id long, source string, size long")
    copies = {r["doc_id"]: int(r["taken"] / max(1, r["size"]) + 0.5) for r in mixing.mix(sized).collect()}
    want = Counter({i: n for i, n in copies.items() if n})
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in out) == want
    lattice = nbest.piece_lattice(PATH)
    for r in out:
        assert r["round_trip"] and r["ids"] == lattice.encode(rows[r["doc_id"]]["text"])[0].tolist()


def test_stages_keep_the_columns_and_stand_odd_rows(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (out.count() > 0) == (start is odd_docs)
