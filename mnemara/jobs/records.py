"""Lifecycle, log and portability queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemara.operators import evaluate, lifecycle, logs, ordered, portable, writes
from mnemara.sources import matrix
from mnemara.sources.tables import memories, table, vectors, versions
from mnemara.streaming import scratch

KEEP = 1000
TAUS = [0.3, 0.4, 0.5]
INSTANT = "2024-01-15 00:00:00"
SWEEP_AT = "2024-01-20 00:00:00"


def _instant(text: str):
    return F.lit(text).cast("timestamp_ntz")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.exact_dedup(memories(spark, sf_dir), "tag", "text", "id")


def latest_per_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest(versions(spark, sf_dir).select("chain", "ts", "id", "value"), "chain", ["ts", "id"])


def scd2_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.version_windows(versions(spark, sf_dir)).select("chain", "id", "version", "valid_from", "valid_to", "is_latest", "source_count")


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lifecycle.version_windows(versions(spark, sf_dir))
    return lifecycle.as_of(w, _instant(INSTANT)).select("chain", "id", "version", "value")


def chain_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two versions of each chain both say latest; the older is demoted."""
    w = lifecycle.version_windows(versions(spark, sf_dir))
    newest_two = w.withColumn("is_latest", F.col("valid_to").isNull() | (F.col("id") % 7 == 0))
    return lifecycle.repair_chains(newest_two, _instant("2025-01-01 00:00:00")).select("chain", "id", "version", "valid_to", "is_latest")


def one_latest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lifecycle.version_windows(versions(spark, sf_dir))
    return lifecycle.latest_violations(w.withColumn("is_latest", F.col("is_latest") | (F.col("id") % 7 == 0)))


def _forgettable(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    return v.select(
        "chain", "id", (F.col("kind") == "supersede").alias("is_forgotten"), F.when(F.col("kind") == "supersede", F.lit("asked")).alias("forget_reason"),
        F.when(F.col("value") > 20, F.col("ts") + F.expr("interval 7 days")).alias("forget_after"),
    )


def forget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.sweep_expired(_forgettable(spark, sf_dir), _instant(SWEEP_AT)).select("id", "is_forgotten", "forget_reason")


def _large_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).groupBy("chain").agg(F.max("value").alias("top")).where("top > 90").select("chain")


def forget_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lifecycle.forget_chains(_forgettable(spark, sf_dir), _large_chains(spark, sf_dir), "too large")
    return out.select("chain", "id", "is_forgotten", "forget_reason")


def undo_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lifecycle.forget_chains(_forgettable(spark, sf_dir), _large_chains(spark, sf_dir), "", undo=True)
    return out.select("chain", "id", "is_forgotten", "forget_reason", "forget_after")


def visible_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.visible(_forgettable(spark, sf_dir), _instant(SWEEP_AT)).select("chain", "id")


def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    return lifecycle.newest(e, KEEP, ["ts", "event_id"]).select("event_id", "event_type")


def retention_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    return lifecycle.pruned(e, KEEP, "event_id", ["ts", "event_id"]).select("event_id", "event_type")


def upsert_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances, put over by the totals of those who have orders."""
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.round("c_acctbal", 2).alias("value"))
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.round(F.max("o_totalprice"), 2).alias("value"))
    return lifecycle.upsert(state, changes, ["key"])


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges from documents to their source, then to those of their language, where they aren't there."""
    d = table(spark, sf_dir, "documents")
    state = d.where("lang = 'en'").select("source", "lang").distinct()
    return lifecycle.insert_ignore(state, d.select("source", "lang"), ["source", "lang"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents, labels and vectors, by table, when the documents of one language go."""
    d = table(spark, sf_dir, "documents")
    gone = d.where("lang = 'fr'").select("doc_id")
    out = d.join(gone, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("name"), "n")
    for name, key in (("labels", "doc_id"), ("embeddings", "vec_id")):
        kept = table(spark, sf_dir, name).select(F.col(key).alias("doc_id")).join(gone, "doc_id", "left_anti")
        out = out.unionByName(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


def supersede_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.supersede_fold(vectors(spark, sf_dir).select(F.col("label").cast("long").alias("space"), "id", "v"), [0.45])


def supersede_one_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors written into one space, which no single task holds; by label, what became of the writes."""
    v = vectors(spark, sf_dir)
    out = ordered.supersede_fold(v.select(F.lit(0).alias("space"), "id", "v"), [0.4])
    merged = F.sum((F.col("action") == "superseded").cast("long"))
    return out.join(v.select("id", "label"), "id").groupBy("label").agg(F.count(F.lit(1)).alias("writes"), merged.alias("superseded"), F.max("version").alias("longest"))


def supersede_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as versions of one fact for every third label, as facts of their own for the others: what thresholds do to them."""
    v = vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min("id").alias("first"))
    kind = F.when(F.col("label") % 3 == 0, "correction").when(F.col("label") % 3 == 1, "distinct").otherwise("unrelated")
    role = F.when(F.col("id") == F.col("first"), "original").otherwise("update")
    rows = v.join(first, "label").select(F.lit(0).alias("space"), "id", F.col("label").cast("string").alias("grp"), role.alias("role"), kind.alias("kind"), "v")
    return ordered.study(rows, TAUS)


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.supersede_fold(vectors(spark, sf_dir).select(F.col("label").cast("long").alias("space"), "id", "v"), TAUS)
    merged = F.sum((F.col("action") == "superseded").cast("long"))
    return out.groupBy("tau").agg(F.count(F.lit(1)).alias("writes"), merged.alias("superseded"), F.count_distinct("space", "slot").alias("survivors"))


def _write_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A third of the documents as a state of single versions, and all of them written into it, some in spite of duplicates."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("space"), "text")
    none, now = F.lit(None), F.to_timestamp(F.lit(INSTANT))
    flags = {"is_static": F.lit(False), "is_inference": F.lit(False), "metadata": none.cast("string"), "forget_after": none.cast("timestamp"), "forget_reason": none.cast("string")}
    vector = F.array(F.col("seq").cast("double"), F.lit(1.0))
    key = F.concat(F.lit("m"), F.lpad(F.col("seq").cast("string"), 12, "0"))
    state = d.where("seq % 3 = 0").select(
        key.alias("id"), "space", "text", vector.alias("v"), *[c.alias(k) for k, c in flags.items()], F.lit(True).alias("is_latest"), F.lit(False).alias("is_forgotten"), F.lit(1).alias("version"),
        key.alias("root"), none.cast("string").alias("parent"), F.lit(1).alias("source_count"), none.cast("timestamp").alias("valid_from"), none.cast("timestamp").alias("valid_to"),
    )
    sets = F.when(F.col("seq") % 5 == 0, F.array(F.lit("is_static"))).otherwise(F.array().cast("array<string>"))
    ops = d.select(
        "seq", "space", F.lit("write").alias("kind"), none.cast("string").alias("target"), none.cast("int").alias("base"), "text", vector.alias("v"), (F.col("seq") % 5 == 0).alias("is_static"),
        *[c.alias(k) for k, c in flags.items() if k != "is_static"], sets.alias("sets"), (F.col("seq") % 7 != 0).alias("dedupe"),
    )
    path = scratch.shared_folder(spark, "decided")
    writes.decide(state, ops, now, tau=2.0).write.parquet(path)  # a cosine never reaches 2: exact duplicates alone decide
    return state, ops, spark.read.parquet(path)


def write_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, decided = _write_batch(spark, sf_dir)
    return decided.where("seq is not null").select("seq", "action", "version")


def write_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batch leaves, by space and flag."""
    after = writes.applied(*_write_batch(spark, sf_dir))
    return after.groupBy("space", "is_static").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5("text")).alias("texts"), F.sum(F.length("text")).alias("chars"))


def _op(kind, target, base, text, v, sets):
    none = F.lit(None)
    return [
        kind.alias("kind"), target.alias("target"), base.cast("int").alias("base"), text.alias("text"), v.alias("v"), F.lit(True).alias("is_static"), F.lit(False).alias("is_inference"),
        none.cast("string").alias("metadata"), none.cast("timestamp").alias("forget_after"), none.cast("string").alias("forget_reason"), sets.alias("sets"), F.lit(True).alias("dedupe"),
    ]


def write_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents in a row as versions of one memory, and an edit of each: corrections of old and new texts, with and without a
    vector, from the right version or another, patches, and targets that aren't there."""
    none, empty = F.lit(None), F.array().cast("array<string>")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "lang", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / 3).alias("chain"), (F.col("doc_id") % 3 + 1).cast("int").alias("version"))
    key = lambda c: F.concat(F.lit("m"), F.lpad(c.cast("string"), 12, "0"))
    last = d.groupBy("chain").agg(F.max("seq").alias("last"), F.min_by("lang", "seq").alias("space"))
    d = d.join(last, "chain")
    latest = F.col("seq") == F.col("last")
    state = d.select(
        key(F.col("seq")).alias("id"), "space", "text", F.array(F.col("seq").cast("double"), F.lit(1.0)).alias("v"), F.lit(False).alias("is_static"), F.lit(False).alias("is_inference"), none.cast("string").alias("metadata"),
        none.cast("timestamp").alias("forget_after"), none.cast("string").alias("forget_reason"), latest.alias("is_latest"), F.lit(False).alias("is_forgotten"), "version", key(F.col("chain") * 3).alias("root"),
        F.when(F.col("version") > 1, key(F.col("seq") - 1)).alias("parent"), F.lit(1).alias("source_count"), none.cast("timestamp").alias("valid_from"), none.cast("timestamp").alias("valid_to"),
    )
    k = F.col("chain") % 6
    text = F.when(k == 1, F.col("text")).otherwise(F.concat("text", F.lit(" once more")))
    vector = F.when(k != 2, F.array(F.lit(1.0), F.col("seq").cast("double")))
    target = F.when(k == 3, F.lit("nobody")).otherwise(key(F.col("seq")))
    base = F.when(k == 4, F.col("version") + 1).when(k == 0, F.col("version"))
    kind = F.when(k == 5, "patch").otherwise("correct")
    ops = d.select("seq", "space", *_op(kind, target, base, text, vector, F.when(k == 5, F.array(F.lit("is_static"))).otherwise(empty)))
    out = writes.decide(state, ops, F.to_timestamp(F.lit(INSTANT)), tau=2.0).where("seq is not null")
    return out.select("seq", "action", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("latest_id", F.lit("")).alias("latest_id"))


def write_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written into the spaces of their labels, near ones over each other: by space, what became of the writes."""
    v = vectors(spark, sf_dir)
    none = F.lit(None)
    text = F.concat(F.lit("fact "), F.col("id").cast("string"))
    ops = v.select(F.col("id").alias("seq"), F.col("label").cast("string").alias("space"), *_op(F.lit("write"), none.cast("string"), none, text, F.col("v"), F.array().cast("array<string>")))
    state = spark.createDataFrame([], f"{writes._ROW}, text string, v array<double>")
    out = writes.decide(state, ops, F.to_timestamp(F.lit(INSTANT)), tau=0.3).where("seq is not null")
    return out.groupBy("space", "action").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("longest"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("code"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("props").alias("message"))


def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.error_groups(_errors(spark, sf_dir), ["code", "k"])


def error_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.newest(_errors(spark, sf_dir).where("code = 'error'"), 50, ["ts", "event_id"]).select("event_id", "ts", "message")


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, floor=True)


def owned_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories laid out by owner, read for the spaces of one kind: a join that opens the folders of their owners only."""
    store = matrix.stored_by(memories(spark, sf_dir).select("id", "text", F.col("tag").alias("org")), scratch.shared_folder(spark, "owned"), "org")
    spaces = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("org")).agg(F.count(F.lit(1)).alias("n")).where("org <> 'en'")
    return store.join(F.broadcast(spaces), "org").groupBy("org").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min("id").alias("first"))


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = lifecycle.version_windows(versions(spark, sf_dir))
    order = Window.partitionBy("chain").orderBy("version")
    return portable.export_chains(w.withColumn("parent", F.lag("id").over(order)).withColumnRenamed("props", "memory"))


def export_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export, read back flat."""
    return portable.read_chains(_exported(spark, sf_dir)).select("chain", "version", "exportId", "parentExportId", "isLatest", "memory", "validFrom", "validTo")


def import_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable.validate_chains(portable.read_chains(_exported(spark, sf_dir)))


def import_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable.remap(portable.read_chains(_exported(spark, sf_dir)))


_VERSIONS = "e AS (SELECT user_id AS chain, event_id AS id, ts, value, CASE WHEN event_type = 'error' THEN 'supersede' ELSE 'correct' END AS kind, props FROM events)"
_WINDOWS = f"""{_VERSIONS}, w AS (
  SELECT chain, id, ts, value, props, row_number() OVER o AS version, CASE WHEN row_number() OVER o > 1 THEN ts END AS valid_from, lead(ts) OVER o AS valid_to,
    lead(ts) OVER o IS NULL AND lead(id) OVER o IS NULL AS is_latest, lag(id) OVER o AS parent,
    (sum(CASE WHEN kind = 'supersede' THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY ts, id ROWS UNBOUNDED PRECEDING)
      - CASE WHEN first_value(kind) OVER o = 'supersede' THEN 1 ELSE 0 END + 1)::BIGINT AS source_count
  FROM e WINDOW o AS (PARTITION BY chain ORDER BY ts, id))"""
_FORGET = "f AS (SELECT user_id AS chain, event_id AS id, event_type = 'error' AS is_forgotten, CASE WHEN event_type = 'error' THEN 'asked' END AS forget_reason, CASE WHEN value > 20 THEN ts + INTERVAL 7 DAYS END AS forget_after FROM events)"
_LARGE = "(SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 90)"
_HASH = "'h_' || substr(sha256({}::VARCHAR), 1, 16)"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
_FLAT = f"""{_WINDOWS}, x AS (
  SELECT chain, version::INTEGER AS version, {_HASH.format('id')} AS "exportId", {_HASH.format('parent')} AS "parentExportId", is_latest AS "isLatest", props AS memory,
    {_ISO.format('valid_from')} AS "validFrom", {_ISO.format('valid_to')} AS "validTo" FROM w)"""

_BATCH = """k AS (
  SELECT doc_id AS seq, lang AS space, text, doc_id % 7 <> 0 AS dedupe, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) > 1 OR bool_or(doc_id % 3 = 0) OVER (PARTITION BY lang, text) AS there FROM documents
), a AS (SELECT seq, space, text, CASE WHEN NOT dedupe OR NOT there THEN 'created' WHEN seq % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM k)"""

QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup, latest_per_chain, scd2_windows, as_of, chain_repair, one_latest_violations, forget_sweep, forget_chain, undo_forget, visible_memories,
        retention_keep, retention_drop, upsert_profiles, insert_ignore, cascade_delete, supersede_fold, supersede_one_space, supersede_study, threshold_sweep, write_batch, write_state, write_edits, write_near, error_groups, error_occurrences,
        percentile_nearest, percentile_floor, owned_memories, export_chains, import_validate, import_remap,
    )
}

SQL = {
    "exact_dedup": "WITH k AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lang, text) AS kept FROM documents) SELECT id, kept, CASE WHEN id = kept THEN 'created' ELSE 'unchanged' END AS action FROM k",
    "latest_per_chain": "SELECT user_id AS chain, ts, event_id AS id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "scd2_windows": f"WITH {_WINDOWS} SELECT chain, id, version::INTEGER AS version, valid_from, valid_to, is_latest, source_count FROM w",
    "as_of": f"WITH {_WINDOWS} SELECT chain, id, version::INTEGER AS version, value FROM w WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{INSTANT}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{INSTANT}')",
    "chain_repair": f"""WITH {_WINDOWS}, l AS (SELECT *, valid_to IS NULL OR id % 7 = 0 AS said FROM w),
  r AS (SELECT *, CASE WHEN said THEN row_number() OVER (PARTITION BY chain ORDER BY version DESC, ts DESC, id DESC) END AS no FROM l),
  d AS (SELECT *, said AND no > min(no) OVER (PARTITION BY chain) AS demote FROM r)
SELECT chain, id, version::INTEGER AS version, CASE WHEN demote THEN coalesce(valid_to, TIMESTAMP '2025-01-01') ELSE valid_to END AS valid_to, said AND NOT demote AS is_latest FROM d""",
    "one_latest_violations": f"WITH {_WINDOWS} SELECT chain, count(*) FILTER (is_latest OR id % 7 = 0)::BIGINT AS n_latest FROM w GROUP BY chain HAVING n_latest > 1",
    "forget_sweep": f"""WITH {_FORGET}, d AS (SELECT *, NOT is_forgotten AND forget_after IS NOT NULL AND forget_after <= TIMESTAMP '{SWEEP_AT}' AS due FROM f)
SELECT id, is_forgotten OR due AS is_forgotten, CASE WHEN due THEN coalesce(forget_reason, 'expired') ELSE forget_reason END AS forget_reason FROM d""",
    "forget_chain": f"WITH {_FORGET} SELECT chain, id, is_forgotten OR chain IN {_LARGE} AS is_forgotten, CASE WHEN chain IN {_LARGE} THEN 'too large' ELSE forget_reason END AS forget_reason FROM f",
    "undo_forget": f"WITH {_FORGET} SELECT chain, id, is_forgotten AND chain NOT IN {_LARGE} AS is_forgotten, CASE WHEN chain NOT IN {_LARGE} THEN forget_reason END AS forget_reason, CASE WHEN chain NOT IN {_LARGE} THEN forget_after END AS forget_after FROM f",
    "visible_memories": f"WITH {_FORGET} SELECT chain, id FROM f WHERE NOT is_forgotten AND (forget_after IS NULL OR forget_after > TIMESTAMP '{SWEEP_AT}')",
    "retention_keep": f"SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT {KEEP}",
    "retention_drop": f"SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT {KEEP})",
    "upsert_profiles": "SELECT c_custkey AS key, round(c_acctbal, 2) AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey AS key, round(max(o_totalprice), 2) AS value FROM orders GROUP BY o_custkey",
    "insert_ignore": "SELECT DISTINCT source, lang FROM documents",
    "cascade_delete": """WITH gone AS (SELECT doc_id FROM documents WHERE lang = 'fr')
SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (FROM gone)
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (FROM gone)""",
    "write_batch": f"WITH {_BATCH} SELECT seq, action, 1 AS version FROM a",
    "write_edits": """WITH d AS (SELECT doc_id AS seq, doc_id // 3 AS chain, doc_id % 3 + 1 AS version, max(doc_id) OVER (PARTITION BY doc_id // 3) AS last FROM documents)
SELECT seq, CASE WHEN chain % 6 = 3 THEN 'missing' WHEN seq <> last THEN 'stale' WHEN chain % 6 = 4 THEN 'conflict' WHEN chain % 6 IN (1, 5) THEN 'updated' WHEN chain % 6 = 2 THEN 'dropped' ELSE 'versioned' END AS action,
  CASE WHEN chain % 6 = 3 OR chain % 6 = 2 AND seq = last THEN 0 WHEN chain % 6 = 0 AND seq = last THEN version + 1 ELSE version END::INTEGER AS version,
  CASE WHEN chain % 6 <> 3 AND (seq <> last OR chain % 6 = 4) THEN 'm' || lpad(last::VARCHAR, 12, '0') ELSE '' END AS latest_id FROM d""",
    "write_state": f"""WITH {_BATCH}, first AS (
  SELECT space, text, min(id) AS id FROM (SELECT lang AS space, text, 'm' || lpad(doc_id::VARCHAR, 12, '0') AS id FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT space, text, 'm_' || substr(sha256(space || '/' || seq), 1, 20) FROM a WHERE action = 'created') GROUP BY space, text
), set_at AS (SELECT space, text, seq FROM a WHERE action = 'updated'),
rows AS (
  SELECT lang AS space, text, 'm' || lpad(doc_id::VARCHAR, 12, '0') AS id, false AS born FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT space, text, 'm_' || substr(sha256(space || '/' || seq), 1, 20), seq % 5 = 0 FROM a WHERE action = 'created'
), now AS (
  SELECT r.space, r.text, r.id, born OR r.id IN (SELECT target FROM (
      SELECT (SELECT min(x.id) FROM (SELECT lang AS space, text, -1 AS seq, 'm' || lpad(doc_id::VARCHAR, 12, '0') AS id FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT space, text, seq, 'm_' || substr(sha256(space || '/' || seq), 1, 20) FROM a WHERE action = 'created') x WHERE x.space = u.space AND x.text = u.text AND x.seq < u.seq) AS target
      FROM set_at u)) AS is_static FROM rows r
) SELECT space, is_static, count(*)::BIGINT AS n, count(DISTINCT md5(text))::BIGINT AS texts, sum(length(text))::BIGINT AS chars FROM now GROUP BY space, is_static""",
    "error_groups": """SELECT event_type AS code, (props->>'$.k')::BIGINT AS k, count(*)::BIGINT AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, arg_max_null(props, (ts, event_id)) AS last_message
FROM events GROUP BY 1, 2 ORDER BY last_seen DESC, code, k LIMIT 50""",
    "error_occurrences": "SELECT event_id, ts, props AS message FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "percentile_nearest": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n)::BIGINT AS n, min(value) FILTER (i = ceil(0.5 * n)) AS p50, min(value) FILTER (i = ceil(0.95 * n)) AS p95 FROM r GROUP BY event_type""",
    "percentile_floor": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n)::BIGINT AS n, min(value) FILTER (i = least(n, floor(0.5 * n) + 1)) AS p50, min(value) FILTER (i = least(n, floor(0.95 * n) + 1)) AS p95 FROM r GROUP BY event_type""",
    "owned_memories": "SELECT lang AS org, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, min(doc_id) AS first FROM documents WHERE lang <> 'en' GROUP BY lang",
    "export_chains": f"WITH {_FLAT} SELECT * FROM x",
    "import_validate": f"WITH {_FLAT} SELECT chain, count(*)::BIGINT AS n_versions, count(DISTINCT \"exportId\") = count(*) AND count(*) FILTER (trim(memory) = '') = 0 AND count(*) FILTER (\"isLatest\") = 1 AS ok FROM x GROUP BY chain",
    "import_remap": f"""WITH {_FLAT} SELECT chain, version, 'm' || substr(sha256(chain || '/' || "exportId"), 1, 20) AS id, 'm' || substr(sha256(chain || '/' || "parentExportId"), 1, 20) AS parent_id, "isLatest" AS is_latest FROM x""",
}
