from compare import DATA
from pyspark.sql import functions as F

from mnemara.llm import langid


def test_documents_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    got = langid.identify_documents(docs, train).select("doc_id", F.col("lang").alias("got"), "rejected")
    held = got.join(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1), "doc_id").toPandas()
    assert len(held) > 400 and (held.got == held.lang).mean() > 0.99 and not held.rejected.any()


def test_pages(spark):
    out = langid.op3_language(spark, f"{DATA}/sf0.001").toPandas()
    assert len(out) == 50 and (out.lang == out.declared).mean() > 0.95


def test_fusion_by_hand(spark):
    """Two rows of one host: the undecided one follows its host; its own guess is taken out of the counts."""
    import math

    rows = [("h", "d", "s", "en", [-1.0, -9.0], 20, 0)] * 4 + [("h", "d", "s", None, [-5.0, -5.0], 20, 0)]
    ev = spark.createDataFrame(rows, "host string, domain string, suffix string, declared string, ll array<double>, letters long, guess int")
    out = langid.fuse(ev, ["en", "fr"]).where("declared is null").first()
    k, overall = 5.0, [(5 + 2.5) / 10, 2.5 / 10]
    dom = [(4 + k * overall[0]) / (4 + k), k * overall[1] / (4 + k)]
    prior = [(4 + k * dom[0]) / (4 + k), k * dom[1] / (4 + k)]
    suffix = [math.log((4 + k) / (5 + k)), math.log(k / k)]
    s = [math.log(p) + x for p, x in zip(prior, suffix, strict=True)]
    assert out["lang"] == "en" and abs(out["confidence"] - math.exp(s[0]) / sum(map(math.exp, s))) < 1e-5


def test_odd_rows(spark, odd_docs, no_docs):
    kept = langid.drop_unidentified(odd_docs, odd_docs)
    assert kept.schema == odd_docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {2, 3, 4} & set(ids) and {1, 5, 6, 8} <= set(ids) and None in ids and ids.count(5) == 2
    assert langid.drop_unidentified(no_docs, no_docs).count() == 0
    assert langid.drop_unidentified(odd_docs, no_docs).count() == 0  # nothing to learn from


def test_odd_pages(spark, odd_docs):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<p>plain text of the river and the mill"), (None, "http://x.fr/", "<html lang='FR'>le la les des"), (4, "https://u:p@a.b.co.uk:80/x", "<html  lang=en><script>var des les</script>the river ran past the mill")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.identify_pages(pages, odd_docs).collect()}
    assert len(got) == 5 and got[1]["lang"] == "und" and got[4]["host"] == "a.b.co.uk" and got[4]["domain"] == "co.uk" and got[None]["declared"] == "fr"
    assert langid.identify_pages(pages.limit(0), odd_docs).count() == 0


def test_slices_change_nothing(monkeypatch):
    import numpy as np

    texts = ["", "   ", "a", "ab", " Ça va?  — oui,   très bien. ", "x" * 5000, "éa 日本  \n\n b" * 40]
    whole = [np.concatenate([*langid.trigrams(t), np.zeros(0, np.int64)]) for t in texts]
    monkeypatch.setattr(langid, "SLICE", 3)
    for t, w in zip(texts, whole, strict=True):
        assert np.concatenate([*langid.trigrams(t), np.zeros(0, np.int64)]).tolist() == w.tolist()
    assert [len(w) for w in whole[:4]] == [0, 0, 1, 2]


def test_unknown_languages_and_random_letters_are_rejected(spark):
    import random

    rng = random.Random(2)
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(5)]
    planted = spark.createDataFrame([(10**9 + i, t, None, "s") for i, t in enumerate([finnish, *noise])], docs.schema)
    got = {r["doc_id"]: r["rejected"] for r in langid.identify_documents(docs.unionByName(planted), docs).collect()}
    assert all(got[10**9 + i] for i in range(6)) and not any(v for k, v in got.items() if k < 10**9)


def test_pages_against_a_plain_version(spark):
    """Every page of the smallest table: training, evidence, counts and fusion once more in plain Python."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    sf = f"{DATA}/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    langs = sorted({r["lang"] for r in docs if r["lang"] is not None})
    n = {x: np.full(langid.BUCKETS, 0.5) for x in langs}
    for r in docs:  # fewer than the sample's bound
        if r["lang"] is not None:
            for g in langid.trigrams(r["text"]):
                np.add.at(n[r["lang"]], g, 1)
    logp = {x: np.log(c / c.sum()).astype(np.float32) for x, c in n.items()}
    pages = [r.asDict() for r in langid.page_rows(spark.read.parquet(f"{sf}/pages.parquet")).collect()]
    for p in pages:
        g = np.concatenate([*langid.trigrams(langid.page_text(p["text"])), np.zeros(0, np.int64)])
        p["ll"], p["letters"] = [float(logp[x][g].sum(dtype=np.float64)) * langid.TEMPER for x in langs], len(g)
        p["guess"] = int(np.argmax(p["ll"])) if len(g) else None
    keys = ("host", "domain", "suffix", "declared")
    count = {k: defaultdict(Counter) for k in keys}
    for p in pages:
        for k in keys:
            if p["guess"] is not None and p[k] is not None:
                count[k][p[k]][p["guess"]] += 1
    seen = [sum(p["guess"] == i for p in pages) for i in range(len(langs))]
    whole, kappa, m = sum(seen), langid.KAPPA, len(langs)
    got = {r["page_id"]: r for r in langid.op3_language(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        def others(k, p=p):
            return [count[k][p[k]][i] - (p["guess"] == i) for i in range(m)] if p[k] in count[k] else None

        prior = [(x + kappa / m) / (whole + kappa) for x in seen]
        for k in ("domain", "host"):
            if (c := others(k)) is not None:
                prior = [(c[i] + kappa * prior[i]) / (sum(c) + kappa) for i in range(m)]
        score, none = [p["ll"][i] + math.log(prior[i]) for i in range(m)], math.log(langid.UNKNOWN) - p["letters"] * math.log(langid.BUCKETS) * langid.TEMPER
        for k in ("suffix", "declared"):
            if (c := others(k)) is not None:
                share = sum(count[k][p[k]].values()) / whole
                score = [score[i] + math.log((c[i] + kappa * share) / (seen[i] + kappa)) for i in range(m)]
                none += math.log(share)
        top = max(score)
        confidence = 1 / sum(math.exp(x - top) for x in [*score, none])
        row = got[p["page_id"]]
        assert row["lang"] == (langs[score.index(top)] if p["letters"] and confidence >= 0.5 else "und")
        assert abs(row["confidence"] - confidence) < 2e-6
