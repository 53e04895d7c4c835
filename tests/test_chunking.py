"""The chunker's DataFrame steps against one loop over each document."""

import random
import time

from plain_chunks import chunk, estimate

from mnemara.operators import chunking

PIECES = [
    "# A", "## B b", "### C", "###### F", "####### no", "#", "#no", "  # not", "\n", "\n\n", "\r\n", "\n \t\n", "```", "```py", "  ```", "~~~", "~~~ x", "````", "| a | b |", "  |---|", "|", "word", "One. Two! Three? ",
    "Version 1.2.3 is out. Next.", "x = 1\n" * 30, "한국어 문장입니다. " * 12, "한" * 70, "𠀀" * 45, "a𠀀b. " * 9, "y" * 130, " ", "　", "\x1c", " ", "\x0b", "long line " * 20, "(end)", "`q`", ".", "﻿", "é! ", "\r", "z" * 400,
]


def some(rng: random.Random) -> str:
    return "".join(rng.choice(PIECES) + rng.choice(["", "\n", "\n", "\n\n", " "]) for _ in range(rng.randrange(1, 40)))


def compare(spark, texts, **values):
    options = chunking.ChunkOptions.clean(**values)
    rows = chunking.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), options).orderBy("id", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append({k: v for k, v in r.asDict().items() if k != "id"})
    for i, t in enumerate(texts):
        assert got.get(i, []) == list(chunk(t or "", options)), (i, t)


def test_equal_to_the_loop(spark):
    rng = random.Random(3)
    texts = [some(rng) for _ in range(400)]
    for values in ({}, {"max_chars": 90, "overlap_chars": 25, "token_budget": 60}, {"max_chars": 40, "overlap_chars": 7, "min_chars": 5, "token_budget": 33}, {"max_chars": 1, "overlap_chars": 1}, {"max_chars": 300, "overlap_chars": 600, "token_budget": 40}):
        compare(spark, texts if values.get("max_chars") != 1 else texts[:40], **values)


def test_long_and_odd_texts(spark):
    compare(spark, ["", None, " \n\t\n", "# only", "```", "~~~\n", "a" * 50_000, "# " + "heading " * 3000 + "\n\nbody", "line\n" * 20_000, "| r |\n" * 5_000, "x. " * 30_000, "\n" * 20_000 + "end", " " * 50_000 + "end", "```\n" + "c\n" * 9_000, "p\n\n" * 9_000, "# h\n\nq\n\n" * 2_000, "𠀀" * 5_000])


def test_whole_tables(spark):
    from mnemara.jobs import ingest
    from mnemara.sources.tables import memories

    for table in (memories(spark, "/root/testdata/sf0.001"), ingest._pages(spark, "/root/testdata/sf0.001")):
        compare(spark, [r["text"] for r in table.select("text").collect()])


def test_repeated_rows_and_ids(spark):
    rows = [(1, "one text"), (1, "one text"), (1, "other text"), (None, "no id"), (None, "none either")]
    got = sorted((r["id"] or 0, r["position"], r["content"]) for r in chunking.chunk_documents(spark.createDataFrame(rows, "id long, text string")).collect())
    assert got == [(0, 0, "no id"), (0, 0, "none either"), (1, 0, "one text"), (1, 0, "other text")]
    assert chunking.chunk_documents(spark.createDataFrame([], "id long, text string")).count() == 0


def test_a_text_is_shuffled_once_and_never_leaves_the_engine(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id long, text string").write.parquet(f"{tmp_path}/docs")
    plan = chunking.chunk_documents(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def chunks(spark, *texts, **options):
    """The chunks of each of some texts."""
    rows = chunking.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), chunking.ChunkOptions.clean(**options)).orderBy("id", "position").collect()
    return [[r for r in rows if r["id"] == i] for i in range(len(texts))]


def test_chunks_fit_the_budget(spark):
    """Documents of the original's chunker tests."""
    english, korean, giant, heading, astral, *empty = chunks(
        spark, "# Title\n\n" + "The quick brown fox jumps over the lazy dog. " * 80, "# 소개\n\n" + "메모리 시스템은 사용자가 신뢰할 수 있어야 하고 검사할 수 있어야 한다고 생각합니다. " * 70, "한" * 2000,
        "# " + "제목이 아주 긴 한국어 헤딩 " * 40 + "\n\n" + "본문 내용입니다. " * 60, "𠀀" * 1200, "", " \n\t\n",
    )
    assert len(english) > 1 and not any("token-split" in c["flags"] for c in english)
    assert any("token-split" in c["flags"] for c in korean) and [c["position"] for c in korean] == list(range(len(korean)))
    assert len(giant) > 3 and any("force-split-para+hard-cut" in c["flags"] for c in giant)
    assert any("breadcrumb-truncated" in c["flags"] for c in heading)
    assert len(astral) > 1 and empty == [[], []]
    for c in english + korean + giant + heading + astral:
        assert estimate(c["embedded_content"]) <= 480 and c["tokens"] == estimate(c["content"])
    assert len(chunks(spark, "𠀀" * 400, max_chars=1)[0]) >= 400


def test_chunk_structure(spark):
    long = "A sentence that repeats to build a long paragraph. " * 120
    one, tree, out, two, crlf = chunks(
        spark, "# API\n\n## Auth\n\nUse the bearer token.\n\n```ts\n# no heading\nconst y = 2;\n```\n", "# A\n\nIntro line.\n\n## B\n\n| x | y |\n|---|---|\ntext under it\n\n### C\nlow\n# D\nlast", long,
        "```\n" + "x = 1\n" * 400 + "```", "a\r\n\r\nb",
    )
    (c,) = one
    assert c["content"] == "Use the bearer token.\n\n```ts\n# no heading\nconst y = 2;\n```" and c["embedded_content"].startswith("API > Auth\n\nUse") and c["flags"] == ["tiny"]
    assert [(c["heading_path"], c["content"]) for c in tree] == [("A", "Intro line."), ("A > B", "| x | y |\n|---|---|\n\ntext under it"), ("A > B > C", "low"), ("D", "last")]
    assert tree[2]["flags"] == ["tiny", "mid-sentence"]
    for bad in ({"max_chars": "oops", "token_budget": float("nan"), "min_chars": -5}, {"max_chars": 0.4}, {"max_chars": 0}, {"max_chars": -0.4}):
        assert len(chunks(spark, long, **bad)[0]) == len(out) > 1
    assert out[1]["flags"] == ["force-split-para", "overlap"] and out[1]["content"].startswith("A sentence that") and "\n\n" in out[1]["content"]
    assert "".join(c["content"] for c in chunks(spark, "Version 1.2.3 of a.b is out. " * 100, overlap_chars=1)[0]).count("1.2.3 of a.b") == 100
    assert len(two) > 1 and all("force-split-code" in c["flags"] for c in two)
    assert crlf[0]["content"] == "a\n\nb"


def test_chunking_is_linear(spark):
    began = time.time()
    assert all(chunks(spark, "a" * 1_000_000, "word " * 200_000, "no end " * 100_000, "x\n\n" * 200_000, "!?." * 300_000, "| a |\n" * 100_000))
    assert time.time() - began < 60
