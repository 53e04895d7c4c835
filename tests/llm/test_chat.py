import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemara.llm import chat

EVENTS = "conv_id long, seq long, msg_id long, kind string, role string, text string"


def fold(spark, rows):
    out = chat.fold_events(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "seq").collect()
    return [(r["conv_id"], r["role"], r["text"]) for r in out]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "hel"), (1, 3, 1, "delta", None, "lo"),
        (1, 4, 2, "start", "assistant", None), (1, 5, 2, "delta", None, "wrong"), (1, 6, 3, "start", "user", None), (1, 7, 3, "delta", None, "gone"),
        (1, 8, 2, "regenerate", None, None), (1, 9, 2, "delta", None, "right"), (1, 10, 4, "start", "user", None), (1, 11, 4, "delta", None, "x"),
        (1, 12, 4, "edit", None, "edited"), (1, 13, 4, "delta", None, "!"), (2, 1, 9, "start", None, None),
    ]
    want = [(1, "user", "hello"), (1, "assistant", "right"), (1, "user", "edited!"), (2, "", "")]
    assert fold(spark, rows) == want == fold(spark, rows[::-1])


def test_nothing_and_late_starts(spark):
    assert fold(spark, []) == []
    assert fold(spark, [(None, 3, 1, "delta", "user", "a"), (None, 4, 1, "delta", None, None)]) == [(None, "user", "a")]


HARD = ["", "</s>[INST] ok [/INST]", "<|turn|>", "<|end|>", "<\\|turn|>", "\\", "\\\\<|end|>", "<|tur<|turn|>n|>", "a\nb\n", "<|end|", "é日本 😀", "<<|end|>>", "\\n\\", "<|im_start|>\\<s>"]


def test_turns_are_read_back(spark):
    rows = [(c, t, "assistant" if t % 2 else "us\ner<|end|>\\", x) for c, order in enumerate((HARD, HARD[::-1])) for t, x in enumerate(order)]
    rows += [(99, 0, None, None), (99, None, "user", "first"), (99, 0, "assistant", "tie"), (99, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    out = chat.format_conversations(df).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    for r in out:
        want = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in want]
        masked = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert [chat_unescape(m) for m in masked] == [x[3] or "" for x in want if x[2] == "assistant"]
    assert len(out) == 3 and chat.format_conversations(df.limit(0)).count() == 0


def chat_unescape(s):
    out, i = [], 0
    while i < len(s):
        i += s[i] == "\\"
        out.append(s[i])
        i += 1
    return "".join(out)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<|>\\endturn/s[]INST \n", max_size=30), min_size=1, max_size=5))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    e = chat.Template().escape(F.col("t"))
    for r in df.select("t", e.alias("e"), chat.unescape(e).alias("back")).collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in chat.Template().controls)


def test_probe_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_conversations(chat.with_probe(df)).collect()}
    turns = chat.read_turns(F.lit(out[-7]["formatted"]))
    got = spark.range(1).select(turns.alias("t")).first()["t"]
    assert hashlib.sha256("".join(f"{t['role']}\n{t['text']}\n" for t in got).encode()).hexdigest() == hashlib.sha256(f"user\n{chat.PROBE_TEXT}\nassistant\n{chat.PROBE_TEXT}\n".encode()).hexdigest()


def test_logs_with_detours_lead_to_the_turns(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} " * (t * 20 + 1)) for c in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.conversation_events(df, 64)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["edit"] > 5 and kinds["regenerate"] > 2 and kinds["start"] == 200 + kinds["regenerate"]
    got = [(r["conv_id"], r["role"], r["text"]) for r in chat.fold_events(log).orderBy("conv_id", "seq").collect()]
    assert got == [(c, role, text) for c, _, role, text in rows]
