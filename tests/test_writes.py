"""Write batches on the original's lifecycle fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemara.operators import lifecycle, writes

V = {"dark mode": [1.0, 0, 0, 0], "light mode": [0.95, 0.312, 0, 0], "Denver": [0, 1.0, 0, 0], "Boulder": [0, 0, 1.0, 0], "nothing": [0.0, 0, 0, 0]}
STATE = "id string, space string, text string, v array<double>, is_static boolean, is_inference boolean, metadata string, forget_after timestamp, forget_reason string, is_latest boolean, is_forgotten boolean, version int, root string, parent string, source_count int, valid_from timestamp, valid_to timestamp"
OPS = "seq long, space string, kind string, target string, base int, text string, v array<double>, is_static boolean, is_inference boolean, metadata string, forget_after timestamp, forget_reason string, sets array<string>, dedupe boolean"
NOW = dt.datetime(2026, 3, 1)


def op(seq, text=None, kind="write", target=None, base=None, space="s", dedupe=True, is_inference=False, **flags):
    v = None if text is None else [float(x) for x in V.get(text, [0, 0, 0, 1.0])]
    f = {"is_static": False, "metadata": None, "forget_after": None, "forget_reason": None} | flags
    return (seq, space, kind, target, base, text, v, f["is_static"], is_inference, f["metadata"], f["forget_after"], f["forget_reason"], sorted(flags), dedupe)


@pytest.fixture
def run(spark, tmp_path):
    def one(state, ops, now=NOW, tau=0.9, n=iter(range(99))):
        state = spark.createDataFrame(state, STATE) if isinstance(state, list) else state
        ops = spark.createDataFrame(ops, OPS)
        path = f"{tmp_path}/decided-{next(n)}"
        writes.decide(state, ops, F.lit(now), tau).write.parquet(path)
        decided = spark.read.parquet(path)
        after = spark.createDataFrame(writes.applied(state, ops, decided).collect(), STATE)
        return after, {r["seq"]: r for r in decided.where("seq is not null").collect()}, (ops, decided)

    return one


def actions(done):
    return [done[k]["action"] for k in sorted(done)]


def test_exact_texts_are_written_once(run):
    s, done, (ops, decided) = run([], [op(1, "dark mode"), op(2, "Denver"), op(3, "nothing"), op(4, "dark mode", space="other")])
    assert actions(done) == ["created", "created", "dropped", "created"] and s.count() == 3
    docs, links = writes.provenance(ops, decided)
    assert {(r["space"], r["title"], r["text"]) for r in docs.collect()} == {("s", "Direct memories (2)", "dark mode\n\nDenver"), ("other", "Direct memories (1)", "dark mode")} and links.count() == 3
    s2, done, _ = run(s, [op(5, "Denver"), op(6, "Boulder"), op(7, "Boulder")])
    assert actions(done) == ["unchanged", "created", "unchanged"] and done[7]["id"] == done[6]["id"] and s2.count() == 4
    s3, done, _ = run(s2, [op(8, "Denver", is_static=True, forget_after=dt.datetime(2027, 1, 1))])
    row = s3.where("text = 'Denver'").first()
    assert actions(done) == ["updated"] and row["is_static"] and row["forget_after"] == dt.datetime(2027, 1, 1) and row["version"] == 1 and s3.count() == 4
    s4, done, _ = run(s3, [op(9, "Denver", dedupe=False), op(10, "light mode", dedupe=False)])
    assert actions(done) == ["created", "created"] and s4.count() == 6


def test_near_duplicates_supersede(run):
    s, first, _ = run([], [op(1, "dark mode", is_static=True), op(2, "Denver")])
    s, done, _ = run(s, [op(3, "light mode")], now=NOW + dt.timedelta(days=1))
    old, new = (s.where(F.col("text") == t).first() for t in ("dark mode", "light mode"))
    assert actions(done) == ["superseded"] and done[3]["superseded"] == first[1]["id"] == old["id"]
    assert not old["is_latest"] and new["is_latest"] and old["valid_from"] is None and new["valid_to"] is None
    assert old["valid_to"] == new["valid_from"] == NOW + dt.timedelta(days=1)
    assert (new["version"], new["source_count"], new["root"], new["parent"], new["is_static"]) == (2, 2, old["id"], old["id"], False)
    s, done, _ = run(s, [op(4, "dark mode")], now=NOW + dt.timedelta(days=2))
    assert actions(done) == ["superseded"] and done[4]["version"] == 3 and s.where("is_latest").count() == 2
    chains = s.withColumn("chain", F.col("root"))
    assert lifecycle.latest_violations(chains).count() == 0
    _, done, _ = run([], [op(1, "dark mode"), op(2, "light mode"), op(3, "dark mode")])
    assert actions(done) == ["created", "superseded", "superseded"] and done[3]["version"] == 3


def test_corrections_and_flags(run):
    s, first, _ = run([], [op(1, "dark mode", is_inference=True, metadata='{"a":1}'), op(2, "Denver")])
    target = first[2]["id"]
    s, done, _ = run(s, [op(3, "Boulder", "correct", target, is_static=True)])
    new = s.where("text = 'Boulder'").first()
    assert actions(done) == ["versioned"] and (new["version"], new["source_count"], new["is_static"], new["parent"]) == (2, 1, True, target)
    s2, done, _ = run(s, [op(4, "dark mode", "correct", target), op(5, None, "patch", new["id"], metadata='{"b":2}'), op(6, "x", "correct", "nobody"), op(7, None, "patch", target, is_static=False)])
    assert actions(done) == ["stale", "updated", "missing", "stale"] and done[4]["latest_id"] == done[7]["latest_id"] == new["id"]
    row = s2.where(F.col("id") == new["id"]).first()
    assert row["metadata"] == '{"b":2}' and row["version"] == 2 and row["is_static"] and s2.count() == s.count()
    s3, done, _ = run(s, [op(8, "light mode", "correct", first[1]["id"]), op(9, "Denver", "correct", first[1]["id"]), op(10, "Boulder", "correct", new["id"], base=1), op(11, "nothing", "correct", new["id"], base=2)])
    assert actions(done) == ["versioned", "stale", "conflict", "dropped"] and done[9]["latest_id"] == done[8]["id"]
    kept = s3.where(F.col("id") == done[8]["id"]).first()
    assert kept["is_inference"] and kept["metadata"] == '{"a":1}' and kept["source_count"] == 1
    assert run(s, [])[0].count() == s.count()


def test_forgotten_memories_are_no_duplicates(run):
    s, first, _ = run([], [op(1, "dark mode")])
    s = s.withColumn("is_forgotten", F.lit(True))
    _, done, _ = run(s, [op(2, "dark mode"), op(3, None, "patch", first[1]["id"], is_static=True)])
    assert actions(done) == ["created", "updated"]


def test_secrets_never_reach_the_state(spark):
    ops = spark.createDataFrame([op(1, "key ghp_" + "a" * 36, metadata='{"token":"abc12345xyz"}', forget_reason="password: hunter2222"), op(2, "fine")], OPS)
    got = {r["seq"]: r for r in writes.gated(ops, F.lit(False)).collect()}
    assert got[1]["text"] == "key [redacted: github_token]" and "abc12345" not in got[1]["metadata"] and "hunter" not in got[1]["forget_reason"]
    assert got[1]["redacted"] == ["github_token", "labelled_secret"] and got[2]["text"] == "fine" and got[2]["redacted"] == []
    assert {r["text"] for r in writes.gated(ops, F.lit(True)).collect()} == {"key ghp_" + "a" * 36, "fine"}


def test_near_writes_equal_the_parallel_fold(spark):
    from mnemara.jobs import records
    from mnemara.operators import ordered
    from mnemara.sources.tables import vectors

    sf = "/root/testdata/sf0.001"
    fold = ordered.supersede_fold(vectors(spark, sf).selectExpr("cast(label as string) as space", "id", "v"), [0.3])
    want = {(r["space"], r["action"]): (r["n"], r["longest"]) for r in fold.groupBy("space", "action").agg(F.count("id").alias("n"), F.max("version").alias("longest")).collect()}
    assert {(r["space"], r["action"]): (r["n"], r["longest"]) for r in records.write_near(spark, sf).collect()} == want
    assert {a for _, a in want} == {"created", "superseded"}
