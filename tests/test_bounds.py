"""What one task or one call holds doesn't grow with the tables."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mnemara.jobs import records
from mnemara.operators import postings, writes

SF = "/root/testdata/sf0.001"


def test_a_space_is_folded_in_parts_where_texts_are_independent(spark, monkeypatch):
    """The same rows as in one part a space, and no call has a whole space."""
    key = lambda: sorted(map(str, records._write_batch(spark, SF)[2].drop("valid_to", "valid_from").collect()))
    want = key()
    monkeypatch.setattr(writes, "TOGETHER", 20)
    assert key() == want
    state, ops, _ = records._write_batch(spark, SF)
    plan = writes.decide(state, ops, F.lit("2026-01-01").cast("timestamp"), tau=2.0)._jdf.queryExecution().analyzed().toString()
    assert "_part" in plan
    plan = writes.decide(state, ops, F.lit("2026-01-01").cast("timestamp"), tau=0.9)._jdf.queryExecution().analyzed().toString()
    assert "_part" not in plan


def test_edits_are_folded_in_parts_by_chain(spark, monkeypatch):
    key = lambda: sorted(map(str, records.write_edits(spark, SF).collect()))
    want = key()
    monkeypatch.setattr(writes, "TOGETHER", 20)
    assert key() == want
    assert "_part" in records.write_edits(spark, SF)._jdf.queryExecution().analyzed().toString()


def test_an_edit_of_what_the_batch_writes_keeps_a_space_whole(spark):
    """The second edit's target is the first one's new version."""
    name = "m_" + hashlib.sha256(b"s/1").hexdigest()[:20]
    none = {k: None for k in ("metadata", "forget_after", "forget_reason")}
    row = {"id": "a", "space": "s", "text": "x", "v": [1.0, 0.0], "is_static": False, "is_inference": False, **none, "is_latest": True, "is_forgotten": False, "version": 1, "root": "a", "parent": None, "source_count": 1, "valid_from": None, "valid_to": None}
    state = spark.createDataFrame([row], f"{writes._ROW}, text string, v array<double>")
    op = lambda seq, target, text: {"seq": seq, "space": "s", "kind": "correct", "target": target, "base": None, "text": text, "v": [1.0, 1.0], "is_static": False, "is_inference": False, **none, "sets": [], "dedupe": True}
    kinds = "seq long, space string, kind string, target string, base int, text string, v array<double>, is_static boolean, is_inference boolean, metadata string, forget_after timestamp, forget_reason string, sets array<string>, dedupe boolean"
    ops = spark.createDataFrame([op(1, "a", "y"), op(2, name, "z")], kinds)
    out = writes.decide(state, ops, F.lit("2026-01-01").cast("timestamp"), tau=2.0).where("seq is not null").orderBy("seq").collect()
    assert [(r["action"], r["version"]) for r in out] == [("versioned", 2), ("versioned", 3)]


def test_postings_are_made_of_few_tokens_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    tokens = [[f"w{k}" for k in rng.integers(0, 9, n)] for n in rng.integers(0, 40, 60)] + [None, []]
    b = pa.record_batch([pa.array(range(len(tokens))), pa.array(tokens, pa.list_(pa.string()))], ["id", "t"])
    key = lambda: sorted(map(str, (r for part in postings._positions([b.slice(1)]) for r in part.to_pylist())))
    want = key()
    monkeypatch.setattr(postings, "TOKENS", 50)
    parts = list(postings._bounded([b.slice(1)]))
    assert key() == want and sum(p.num_rows for p in parts) == b.num_rows - 1
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 50 for p in parts) and len(parts) > 10
