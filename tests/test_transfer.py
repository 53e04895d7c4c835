"""Export and import of a store: the cases of the original's export tests."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_writes import STATE

from mnemara.operators import transfer

NOW = dt.datetime(2026, 3, 1)
SCHEMA = f"{STATE}, created_at timestamp, updated_at timestamp, relations map<string,array<string>>"
T1 = dt.datetime(2026, 1, 10)


def memory(i, text, space="s", root=None, parent=None, version=1, latest=True, forgotten=False, window=(None, None), relations=None, reason=None):
    return (i, space, text, [1.0], False, True, '{"k":1}', None, reason, latest, forgotten, version, root or i, parent, version, *window, NOW, NOW, relations)


STORE = [
    memory("a1", "lives in Denver", latest=False, window=(None, T1)),
    memory("a2", "lives in Boulder", root="a1", parent="a1", version=2, window=(T1, None), relations={"updates": ["a1", "outside"], "derives": ["outside"]}),
    memory("b1", "a forgotten fact", forgotten=True, reason="asked"),
    memory("c1", "elsewhere", space="t"),
]


@pytest.fixture
def store(spark):
    docs = spark.createDataFrame([(1, "Guide", "# A\n\nbody of the guide", ["s"]), (2, None, "untitled text", ["t"]), (3, "grouping", "no chunks", ["s"])], "id long, title string, text string, tags array<string>")
    return {
        "memories": spark.createDataFrame(STORE, SCHEMA), "profiles": spark.createDataFrame([("s", '{"static":["x"]}'), ("t", None)], "space string, profile string"), "documents": docs,
        "chunks": spark.createDataFrame([(1,), (1,), (2,)], "document_id long"), "links": spark.createDataFrame([("a2", 1), ("b1", 3), ("zz", 1)], "memory_id string, document_id long"),
    }


def embed(column):
    return F.when(column.contains("fact"), F.lit(None).cast("array<double>")).otherwise(F.array(F.length(column).cast("double"), F.lit(1.0)))


def imported(spark, lines, store=None, run="r"):
    m = store["memories"] if store else spark.createDataFrame([], SCHEMA)
    d = store["documents"] if store else spark.createDataFrame([], "id long, title string, text string, tags array<string>")
    return transfer.import_export(lines, m, d, embed, F.lit(NOW), run)


def exported(spark, store, path, tag=None):
    transfer.write_export(transfer.export_lines(**store, tag=tag), path)
    return transfer.read_export(spark, path)


def test_round_trip(spark, store, tmp_path):
    lines = exported(spark, store, f"{tmp_path}/e")
    raw = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/e").collect())
    assert '"v":' not in raw and "[1.0]" not in raw and "grouping" not in raw
    got = imported(spark, lines)
    m = {r["text"]: r for r in got.memories.collect()}
    assert len(m) == 4 and set(got.memories.columns) == set(store["memories"].columns)
    old, new, gone = m["lives in Denver"], m["lives in Boulder"], m["a forgotten fact"]
    assert not {"a1", "a2", "b1"} & {r["id"] for r in m.values()}
    assert new["parent"] == old["id"] == new["root"] == old["root"] and new["relations"] == {"updates": [old["id"]]} and old["relations"] is None
    assert old["valid_to"] == new["valid_from"] == T1 and (new["version"], new["source_count"], new["is_inference"], new["metadata"]) == (2, 2, True, '{"k":1}')
    assert gone["is_forgotten"] and gone["forget_reason"] == "asked" and gone["v"] is None and new["v"] == [16.0, 1.0] and new["created_at"] == NOW
    assert {(r["space"], r["profile"]) for r in got.profiles.collect()} == {("s", '{"static":["x"]}')}
    docs = {r["title"]: r["id"] for r in got.documents.collect()}
    assert set(docs) == {"Guide", "Untitled"} and got.chunks.count() == 2
    assert [tuple(r) for r in got.links.collect()] == [(new["id"], str(docs["Guide"]))]
    assert {(r["verdict"], r["versions"]) for r in got.chains.collect()} == {("imported", 2), ("imported", 1)}
    only = exported(spark, store, f"{tmp_path}/t", tag="t")
    assert {r["text"] for r in imported(spark, only).memories.collect()} == {"elsewhere"} and only.where("kind = 'document'").count() == 1


def test_importing_again_changes_nothing(spark, store, tmp_path):
    got = imported(spark, exported(spark, store, f"{tmp_path}/e"), store)
    assert got.memories.count() == 0 == got.documents.count() == got.chunks.count() and {r["verdict"] for r in got.chains.collect()} == {"skipped"} == {r["verdict"] for r in got.taken.collect()}
    twice = transfer.export_lines(**store)
    twice.unionByName(twice).write.text(f"{tmp_path}/two")
    got = imported(spark, transfer.read_export(spark, f"{tmp_path}/two"))
    assert got.memories.count() == 4 and got.documents.count() == 2


def test_broken_files_and_chains(spark, store, tmp_path):
    version = {"version": 1, "isLatest": True, "memory": "fine", "exportId": "x"}
    chains = {
        "good": [version], "repeated id": [version | {"memory": "two"}, version], "parent outside": [version | {"memory": "three", "parentExportId": "nobody"}],
        "blank": [version | {"memory": ""}], "empty": [], "no id": [{k: v for k, v in version.items() if k != "exportId"}],
    }
    lines = [{"format": "memory-export", "version": 1}] + [{"kind": "chain", "containerTag": "", "versions": c} for c in chains.values()]
    (tmp_path / "f").write_text("\n".join(map(json.dumps, lines)))
    got = imported(spark, transfer.read_export(spark, f"{tmp_path}/f"))
    assert sorted(r["verdict"] for r in got.chains.collect()) == ["failed"] * 5 + ["imported"]
    row = got.memories.first()
    assert row["text"] == "fine" and row["space"] == "default" and got.memories.count() == 1
    for head in ({"format": "other", "version": 1}, {"format": "memory-export", "version": 2}, {"kind": "chain"}):
        (tmp_path / "g").write_text(json.dumps(head))
        with pytest.raises(ValueError, match="not an export"):
            transfer.read_export(spark, f"{tmp_path}/g")


def test_documents_are_cut_when_asked_for(spark, tmp_path, monkeypatch):
    """What became of chains and documents is known without cutting and embedding them; both tables come of one ingest."""
    from mnemara.operators import chunking

    head = json.dumps({"format": transfer.FORMAT, "version": transfer.VERSION})
    one = json.dumps({"kind": "document", "exportId": "1", "title": "T", "content": "some words", "containerTags": ["x"]})
    (tmp_path / "f").write_text(f"{head}\n{one}\n")
    calls, ingest = [], chunking.ingest
    monkeypatch.setattr(chunking, "ingest", lambda *a: calls.append(1) or ingest(*a))
    got = imported(spark, transfer.read_export(spark, f"{tmp_path}/f"))
    assert got.chains.count() == 0 and [r["verdict"] for r in got.taken.collect()] == ["imported"] and not calls
    assert got.documents.count() == 1 == got.chunks.count() and len(calls) == 1


def test_long_texts_and_documents_without_id(spark, tmp_path):
    """A text over twenty million characters, which a JSON parser refuses by default, comes in; a document without id is one."""
    long = spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit("Long").alias("title"), F.repeat(F.lit("a"), F.lit(21_000_000)).alias("text"), F.array(F.lit("s")).alias("tags"))
    docs = long.unionByName(spark.createDataFrame([(None, None, "no id", ["s"])], "id long, title string, text string, tags array<string>"))
    empty = {"memories": spark.createDataFrame([], SCHEMA), "profiles": spark.createDataFrame([], "space string, profile string"), "links": spark.createDataFrame([], "memory_id string, document_id long")}
    store = empty | {"documents": docs, "chunks": docs.select(F.col("id").alias("document_id"))}
    lines = exported(spark, store, f"{tmp_path}/e")
    assert {r[0] for r in lines.select(F.length("content")).collect()} == {21_000_000, 5}
    assert [r["verdict"] for r in imported(spark, lines).taken.collect()] == ["imported"] * 2 and [r["verdict"] for r in imported(spark, lines, store).taken.collect()] == ["skipped"] * 2


@pytest.mark.parametrize("some_pages", [True, False])
def test_import_counts_equals_sql_on_odd_rows(spark, tmp_path, some_pages):
    """Null and empty texts and languages, ids that are repeated, null, negative or large, vectors twice, and pages that hold next to nothing."""
    import duckdb

    from mnemara.jobs import ingest

    texts = {
        0: "a", 1: "b", 2: None, 3: None, 4: "a", 5: "c", 6: None, 9: None, 12: "", 15: "", 18: "=", 21: "==", 24: "=?", 27: "a", 28: "d", 30: "d",
        -1: "e", -2: "f", -4: "g", 2**31: "h", 2**53 + 1: "i", 2**53 + 2: "j", 2**63 - 1: "k", -(2**63): "l",
    }
    rows = [(i, t, "en") for i, t in texts.items()] + [(300, "m", "en"), (300, "m", "en"), (303, "n", "en"), (303, "n", "de"), (None, "o", "en"), (None, "p", "en")]
    rows += [(400, "q", None), (403, "q", None), (406, "q", ""), (409, "q", ""), (412, "q", "default"), (415, "q", "="), (418, "q", "=default"), (421, None, None)]
    html = [None, "", "  ", "<p>\u00a0\u3000</p>", "<p>\t</p>", "<p>\u200b</p>", "<h1></h1>", "<h1> <b></b></h1>", "<h1>A</h1>", "<script>x</style>", "<script>x</style>y</script>", "<scripté>x</script>", "<\u017fcript>x</SCRIPT>", "<script_>x</script>", "<"]
    pages = [(i, h) for i, h in enumerate(html)] + [(1, "<p>again</p>"), (1, "<p>again</p>"), (None, "<p>z</p>"), (None, "<p>z</p>")]
    con, vectors = duckdb.connect(), [(i, [1.0, 0.0], 0) for i in (0, 0, 4, 4, 300)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string"), ("pages", pages if some_pages else [], "page_id long, html string"), ("embeddings", vectors, "vec_id long, embedding array<double>, label int"),
    ):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in ingest.import_counts(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ingest.SQL["import_counts"]).fetchall()) and len(got) == 6
