"""Streaming queries, replayed from files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemara.jobs import texts
from mnemara.operators import snapshots
from mnemara.streaming import chat, scratch
from mnemara.sources.tables import table


def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts captured from a stream of turns, with the statements of ``planted_facts``."""
    turns = scratch.replay(spark, f"{sf_dir}/conversations.parquet")
    return scratch.drain(chat.capture(turns.withColumn("text", texts.stated(F.col("conv_id") * 7 + F.col("turn")))), "capture")


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts captured from a stream in several batches, folded into a state: how often each was stated, and where first.

    The stream is run a second time with its progress lost, so every batch comes again; batches that are in the state change nothing.
    """
    folder = scratch.shared_folder(spark, "turns")
    table(spark, sf_dir, "conversations").withColumn("text", texts.stated(F.col("turn"))).repartition(4, "conv_id", "turn").write.parquet(folder)
    store = snapshots.Snapshots(spark, scratch.shared_folder(spark, "facts"), "id string, n long, first_conv long")

    def stream() -> DataFrame:
        return chat.capture(spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder))

    def fold(state: DataFrame, batch: DataFrame) -> DataFrame:
        new = batch.groupBy(F.col("fact").alias("id")).agg(F.count(F.lit(1)).alias("m"), F.min("conv_id").alias("c"))
        return new.join(state, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("m")).alias("n"), F.least("first_conv", "c").alias("first_conv"))

    for _ in range(2):
        snapshots.fold_stream(stream(), store, "capture", fold, scratch.shared_folder(spark, "progress"))
    return store.read().select(F.col("id").alias("fact"), "n", "first_conv")


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and other events by hour under a watermark (an extension: the original has no event time).

    Changed hours are put out by each batch, and dropped from state once the watermark has left them.
    """
    events = scratch.replay(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return scratch.drain(counts.select(F.col("window.start").alias("hour"), "event_type", "n", "top"), "counts", "update", keys=["hour", "event_type"])


def _fragment_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch.shared_folder(spark, "fragments")
    chat.fragments(chat.frames(table(spark, sf_dir, "conversations"))).write.parquet(path)
    return path


def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions from the bytes of every stream, cut anywhere."""
    out = scratch.drain(chat.classify_stream(scratch.replay(spark, _fragment_files(spark, sf_dir)), idle_ms=None), "decisions")
    return out.select("conv_id", "kind", "held", "arguments")


def classify_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.classify(chat.frames(table(spark, sf_dir, "conversations")))


def stream_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = chat.stream_sizes(chat.fragments(chat.frames(table(spark, sf_dir, "conversations"))))
    return sizes.select("conv_id", "bytes")


_CLASSIFY = f"""WITH f AS (
  SELECT conv_id, turn, role, text, role = 'user' AND conv_id % 3 <> 0 AS call, bool_or(role = 'user' AND conv_id % 3 <> 0) OVER w AS called FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), t AS (SELECT *, sum(CASE WHEN role = 'assistant' AND NOT called THEN coalesce(length(text), 0) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM f),
a AS (SELECT conv_id, coalesce(min(turn) FILTER (total > {chat.HOLD_CHARS}), max(turn) + 1) AS stop FROM t GROUP BY conv_id),
g AS (SELECT t.conv_id, max(total)::BIGINT AS held, count(*) FILTER (call) AS calls, coalesce(string_agg(text, '' ORDER BY turn) FILTER (call), '') AS arguments
  FROM t JOIN a ON t.conv_id = a.conv_id AND turn <= stop GROUP BY t.conv_id)
SELECT conv_id, CASE WHEN held > {chat.HOLD_CHARS} OR calls = 0 THEN 'answer' WHEN conv_id % 2 <> 0 THEN 'external_tool' ELSE 'memory_tool' END AS kind, held, arguments FROM g"""

QUERIES = {f.__name__: f for f in (stream_capture, stream_state, stream_event_counts, stream_classify, classify_batch, stream_sizes)}
SQL = {
    "stream_capture": texts.SQL["planted_facts"],
    "stream_state": f"""SELECT replace(f, '#', turn::VARCHAR) AS fact, count(*)::BIGINT AS n, min(conv_id) AS first_conv
FROM conversations JOIN (VALUES {texts._FACTS}) t(i, k, f) ON i = turn % {len(texts.STATEMENTS)} WHERE role = 'user' GROUP BY ALL""",
    "stream_event_counts": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n, max(value) AS top FROM events GROUP BY 1, 2",
    "stream_classify": _CLASSIFY,
    "classify_batch": _CLASSIFY,
    "stream_sizes": """WITH f AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN 'data: {"choices":[{"delta":' || CASE WHEN text IS NULL THEN '{}' ELSE '{"content":' || to_json(text) || '}' END || '}]}'
    WHEN role = 'user' AND conv_id % 3 <> 0 THEN 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"' || CASE WHEN conv_id % 2 = 0 THEN 'memory_search' ELSE 'calculator' END || '"'
      || CASE WHEN text IS NULL THEN '' ELSE ',"arguments":' || to_json(text) END || '}}]}}]}' ELSE ': keep-alive' END AS frame FROM conversations)
SELECT conv_id, sum(strlen(frame) + 2)::BIGINT + strlen('data: [DONE]') + 2 AS bytes FROM f GROUP BY conv_id""",
}
