"""Embedding functions, ingest, and the original's evaluation set end to end."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemara.functions import embed
from mnemara.operators import chunking, evaluate, retrieval
from mnemara.operators.retrieval import Recall

#: Words of the evaluation set.
PEOPLE = "Ada Ben Cyra Dale Eli Fran Gio Hana Ira Jules".split()
EDITORS = ["Helix", "Neovim", "Zed", "VS Code", "Nova", "Emacs"]
UNITS = ["metric units", "imperial units", "celsius", "fahrenheit", "24 hour time", "12 hour time"]
REGIONS = "Denver Boston Seattle Austin Chicago Portland Phoenix".split()
SERVICES = "atlas beacon comet delta ember forge granite harbor".split()
COMMANDS = "restart rollback reindex snapshot rotate restore promote".split()


def evaluation_set(seed=20260702):
    """Memories, documents and queries ``(mode, text, gold)`` drawn by a linear congruential generator."""
    state = seed

    def pick(values):
        nonlocal state
        state = (state * 1664525 + 1013904223) % 2**32
        return values[int(state / 2**32 * len(values))]

    memories, documents, queries = {}, {}, []
    for i in range(44):
        t = f"memtoken{i:03}"
        who, editor, unit, region = pick(PEOPLE), pick(EDITORS), pick(UNITS), pick(REGIONS)
        memories[t] = f"Eval memory {t}. {who} prefers {unit}, uses {editor} for agent work, and keeps project notes for {region}. The backup code is code{i}."
        queries.append(("memories", f"For {t}, which editor does {who} use for agent work?", {("memory", t)}))
        if i % 2 == 0:
            d = f"memdistractor{i:03}"
            memories[d] = f"Eval memory {d}. {who} tried {pick(EDITORS)} for agent work, kept old {unit} notes, and mentioned {region} as a decoy project."
    for i in range(36):
        t = f"doctoken{i:03}"
        service, command, region = pick(SERVICES), pick(COMMANDS), pick(REGIONS)
        documents[t] = f"# Runbook {t}\n\nService {service} runs in {region}. The recovery command for {t} is {command}. Near-duplicate services use a different token and must not satisfy this query."
        queries.append(("documents", f"What is the recovery command for {t}?", {("chunk", t)}))
    for i in range(30):
        t = f"hybtoken{i:03}"
        service, owner, command = pick(SERVICES), pick(PEOPLE), pick(COMMANDS)
        memories[t] = f"Hybrid memory {t}. {owner} owns service {service} and reviews its escalation notes weekly."
        documents[t] = f"# Hybrid playbook {t}\n\nService {service} uses the {command} playbook when {t} appears in an incident."
        queries.append(("hybrid", f"For {t}, who owns {service} or which playbook command is used?", {("memory", t), ("chunk", t)}))
    return memories, documents, queries


def test_published_recall_is_reproduced(spark):
    memories, documents, queries = evaluation_set()
    assert (len(memories), len(documents), len(queries)) == (96, 66, 110)
    into = embed.hash_embedder()
    names = list(memories)
    null = [None] * 3
    rows = [(i, memories[n], "eval", 1, True, False, *null) for i, n in enumerate(names)]
    m = spark.createDataFrame(rows, "id long, text string, tag string, version int, is_latest boolean, is_forgotten boolean, forget_after timestamp, valid_from timestamp, valid_to timestamp")
    m = m.withColumn("v", into("text")).withColumn("created_at", F.to_timestamp(F.lit("2026-07-02")))
    titles = list(documents)
    docs, chunks = chunking.ingest(spark.createDataFrame([(i, t, documents[t], ["eval"]) for i, t in enumerate(titles)], "id long, title string, text string, tags array<string>"), into, F.to_timestamp(F.lit("2026-07-02")))
    chunks = chunks.withColumn("id", F.col("document_id")).cache()
    assert chunks.count() == 66
    q = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(queries)], "query_id long, text string").withColumn("q", into("text"))
    options, now = Recall.asked(10, threshold=0.4, tag="eval"), F.to_timestamp(F.lit("2026-07-02"))
    found_m = retrieval.search_memories(m.cache(), q, options, now).cache()
    found_c = retrieval.search_chunks(chunks, docs, q, options).cache()
    both = retrieval.search_hybrid(found_m, found_c, 10)
    lists = {
        "memories": found_m.select("query_id", "rank", F.lit("memory").alias("type"), F.col("id").cast("string").alias("id")),
        "documents": found_c.select("query_id", "rank", F.lit("chunk").alias("type"), F.col("id").cast("string").alias("id")),
        "hybrid": both.select("query_id", "rank", "type", "id"),
    }
    gold = spark.createDataFrame([(i, kind, str((names if kind == "memory" else titles).index(t))) for i, (_, _, g) in enumerate(queries) for kind, t in g], "query_id long, type string, id string")
    for mode, want in (("memories", (44, 0.8409, 1.0, 0.9205)), ("documents", (36, 1.0, 1.0, 1.0)), ("hybrid", (30, 1.0, 1.0, 1.0))):
        asked = spark.createDataFrame([(i,) for i, (k, _, _) in enumerate(queries) if k == mode], "query_id long")
        hits = asked.join(lists[mode], "query_id", "left").join(gold.withColumn("gold", F.lit(True)), ["query_id", "type", "id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
        r = evaluate.score_rankings(hits).first()
        assert (r["n_queries"], round(r["recall_1"], 4), r["recall_10"], round(r["mrr"], 4)) == want, mode


def test_hashed_words(spark):
    v = spark.createDataFrame([("Code7 memory the THE",), ("",), (None,), ("?!",)], "t string").select(embed.hash_embedder(64)("t").alias("v")).collect()
    want = np.zeros(64)
    for word, n in (("code7", 6), ("memory", 2), ("the", 2)):
        h = 2166136261
        for c in word:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        want[h % 64] += n
    assert np.allclose(v[0]["v"], want / np.linalg.norm(want)) and v[1]["v"][0] == v[3]["v"][0] == 1.0 and v[2]["v"] is None


def test_pooling(spark):
    rows = spark.createDataFrame([(1, 0, True, [1.0, 2.0]), (1, 1, True, [3.0, 4.0]), (1, 2, False, [90.0, 90.0]), (2, 0, False, [5.0, 6.0])], "id long, place int, mask boolean, v array<double>")
    got = {how: {r["id"]: r["v"] for r in embed.pooled(rows, how).collect()} for how in ("mean", "first", "last")}
    assert got == {"mean": {1: [2.0, 3.0], 2: [0.0, 0.0]}, "first": {1: [1.0, 2.0], 2: [5.0, 6.0]}, "last": {1: [3.0, 4.0], 2: [5.0, 6.0]}}


def test_half_precision_cuts():
    x = np.array([1.0, -2.5, 1.0009, 65504.0, 1e6, -1e6, 1e-6, -1e-6, 0.1], np.float32)
    got = embed.to_half(x).astype(np.float32)
    assert got[:3].tolist() == [1.0, -2.5, 1.0] and got[3] == 65504 and np.isinf(got[4:6]).all() and got[6] == 0 and np.signbit(got[7]) and 0 <= 0.1 - got[8] < 1e-4


def test_static_matrix_from_a_file(spark, tmp_path):
    matrix = np.arange(12, dtype=np.float32).reshape(4, 3)
    head = json.dumps({"__metadata__": {"x": "y"}, "embeddings": {"dtype": "F32", "shape": [4, 3], "data_offsets": [0, 48]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + matrix.tobytes())
    read = embed.read_matrix(spark, f"{tmp_path}/m.safetensors")
    assert read.dtype == np.float16 and (read == matrix).all()
    ids = spark.createDataFrame([([1, 3, 99, -1],), ([],), (None,), ([7],)], "ids array<int>")
    got = [r["v"] for r in ids.select(embed.static_embedder(spark, read)("ids").alias("v")).collect()]
    mean = matrix[[1, 3]].mean(axis=0)
    assert np.allclose(got[0], mean / np.linalg.norm(mean)) and got[1] == got[3] == [0.0, 0.0, 0.0] and got[2] is None


def test_payloads(spark):
    d = spark.createDataFrame([(1, "a" * 30), (1, "b" * 5), (2, "c" * 30)], "r long, t string")
    got = sorted((r["r"], r["t"]) for r in embed.within_payload(d, "r", "t", 62).collect())
    assert got == [(1, "a" * 15), (1, "b" * 5), (2, "c" * 30)]


def test_ingest_replaces_and_skips(spark, tmp_path):
    now = F.to_timestamp(F.lit("2026-01-01"))
    some = F.udf(lambda t: None if "bad" in t else [0.0, 0.0] if "zero" in t else [1.0, 0.0], "array<double>")
    rows = [(1, " One ", "# A\n\ngood text here\n\n# B\n\nbad text\n\n# C\n\nzero text", ["x"]), (2, None, "plain", ["x"]), (3, "none", "", ["x"]), (4, "null", None, None), (5, "long", "y" * 50, ["x"])]
    docs, chunks = chunking.ingest(spark.createDataFrame(rows, "id long, title string, text string, tags array<string>"), some, now, most_chars=60)
    got = {r["id"]: (r["title"], r["chunk_count"], r["skipped_chunks"]) for r in docs.collect()}
    assert got == {1: ("One", 1, 2), 2: ("Untitled", 1, 0), 5: ("long", 1, 0)}
    assert docs.where("id = 1").first()["flags"] == {"tiny": 3, "mid-sentence": 3}
    again = chunking.ingest(spark.createDataFrame([(1, "One", "new words", ["x"])], "id long, title string, text string, tags array<string>"), some, now)
    d2, c2 = chunking.replaced(docs, chunks, *again)
    assert sorted(r["content"] for r in c2.collect()) == ["new words", "plain", "y" * 50] and d2.count() == 3
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.txt").write_text("no")
    assert [(r["title"], r["text"]) for r in chunking.markdown_folder(spark, str(tmp_path)).collect()] == [("a.md", "# T\n\nbody")]
