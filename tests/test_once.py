"""Tables that a search or an ingest reads several times are computed once, and texts stay in their task where they can."""

import pytest
from pyspark.sql import functions as F

from mnemara.operators import chunking, retrieval

WORDS = [f"word{'x' * (i % 5)}{i}" for i in range(40)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Pages and chunks as files, so that plans tell who reads them."""
    base = tmp_path_factory.mktemp("stored")
    spark.createDataFrame([(i, f"t{i}", f"# H{i}\n\n{WORDS[i]} {WORDS[(i + 1) % 40]} text.", ["x"]) for i in range(40)], "id long, title string, text string, tags array<string>").write.parquet(f"{base}/pages")
    rows = [(i, i if i != 3 else 99, f"{WORDS[i]} {WORDS[(i + 1) % 40]}", "", [float(i + 1), 1.0]) for i in range(40)]
    spark.createDataFrame(rows, "id long, document_id long, content string, heading_path string, v array<double>").write.parquet(f"{base}/chunks")
    return spark.read.parquet(f"{base}/pages"), spark.read.parquet(f"{base}/chunks")


def test_ingest_reads_its_pages_once(spark, stored):
    pages, _ = stored
    docs, chunks = chunking.ingest(pages, F.udf(lambda t: [1.0], "array<double>"), F.to_timestamp(F.lit("2026-01-01")))
    assert not set(pages.inputFiles()) & {*docs.inputFiles(), *chunks.inputFiles()}
    assert docs.count() == 40 and chunks.count() == 40


@pytest.mark.parametrize("most", [20_000, 1])
def test_search_joins_chunks_and_documents_once(spark, stored, monkeypatch, most):
    """A chunk without its document isn't found; the same with the result's rows sent or shuffled."""
    pages, chunks = stored
    queries = spark.createDataFrame([(i, WORDS[i], [1.0, 0.0]) for i in range(5)], "query_id long, text string, q array<double>")
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_SETS", most)
    out = retrieval.search_chunks(chunks, pages, queries, retrieval.Recall.asked(3, threshold=2.0))
    assert not {*pages.inputFiles(), *chunks.inputFiles()} & set(out.inputFiles())
    want = {(q, i, f"t{i}", "keyword") for q in range(5) for i in (q - 1, q, 39 if q == 0 else q) if 0 <= i != 3}
    assert {(r["query_id"], r["id"], r["title"], r["source"]) for r in out.collect()} == want


def test_keyword_texts_meet_many_words_in_their_task(spark, stored, monkeypatch):
    _, chunks = stored
    data = chunks.select("id", F.col("content").alias("text"))
    queries = spark.createDataFrame([*((i, w) for i, w in enumerate(WORDS)), (50, f"{WORDS[2]} -{WORDS[3]}"), (51, f'"{WORDS[4]} {WORDS[5]}" or {WORDS[9]}')], "query_id long, text string")
    rows = lambda df: {(r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}
    assert len(WORDS) > retrieval.FEW_KEYS
    got = retrieval.keyword_hits(data, queries, 5)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    monkeypatch.setattr(retrieval, "FEW_KEYS", 0)
    monkeypatch.setattr(retrieval, "MANY_KEYS", 0)
    assert rows(got) == rows(retrieval.keyword_hits(data, queries, 5)) and len(rows(got)) == 40 * 2 + 1 + 3
