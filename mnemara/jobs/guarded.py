"""Validation, redaction and merge queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemara.functions import guards
from mnemara.operators import lifecycle
from mnemara.sources.tables import memories, table
from mnemara.streaming import scratch

MOST = 10_000


def as_of_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's time as a literal in one of five forms, two of which name no instant."""
    e = table(spark, sf_dir, "events")
    forms = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+05:00'", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy"]
    literal = F.element_at(F.array(*[F.date_format("ts", f) for f in forms]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", literal.alias("literal")).withColumn("instant", guards.instant(F.col("literal")))


def report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" <script>"))).otherwise(F.concat("event_type", F.lit("_"), F.col("user_id").cast("string")))
    return e.groupBy(guards.report_name(name, "unknown").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    return m.select("id", F.coalesce(guards.rejected(F.col("text"), MOST), F.lit("ok")).alias("verdict"))


def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's JSON, with a nested member, and its type set beside what is there; its number replaced for errors."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type").cast("variant")
    extra = F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit(-1).cast("variant"), F.lit("type"), kind)).otherwise(F.create_map(F.lit("type"), kind))
    nested = F.concat(F.lit('{"deep":{"id":'), F.col("event_id").cast("string"), F.lit(',"none":null,"list":[1,"1",true]},'), F.substring("props", 2, 1_000_000))
    return e.select("event_id", guards.merged(nested, extra).alias("props"))


TOOL = '{"type":"function","function":{"name":"memory_search"}}'


def injected_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one turn each: the profile goes to a system message of a text, of parts, of another kind, or to a new one; the tool is there, mended or added."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 4).cast("int").alias("k"))
    system = ('{"role":"system","content":"Be brief.","n":1}', '{"role":"system","content":[{"type":"text","text":"a"}]}', '{"role":"system","content":7}', '{"role":"user","content":"b"}')
    tools = ("[]", TOOL.join("[]"), '[{"name":"memory_search"},{"name":"other","n":1.5}]', '"none"')
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("k") + 1)
    user = F.concat(F.lit(',{"role":"user","content":"'), F.col("turn").cast("string"), F.lit('"}]'))
    block = F.concat(F.lit("\n\nfact "), F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", guards.with_profile(F.concat(F.lit("["), pick(system), user), block).alias("messages"), guards.with_tool(pick(tools), "memory_search", TOOL).alias("tools"))


def redact_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as logged requests with keys of every class, nested and in lists."""
    p = table(spark, sf_dir, "pages")
    inner = F.struct(F.col("html").alias("content"), F.lit("ok").alias("status"))
    logged = F.to_json(
        F.struct(
            F.col("page_id").alias("n"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("userId"), F.col("url").alias("path"), F.lit("search").alias("kind"),
            F.col("html").alias("text"), F.array(inner).alias("messages"), inner.alias("document"), F.array(F.col("url")).alias("mode"), F.array(F.col("url")).alias("file"),
            F.struct(F.col("url").alias("note"), F.lit("E1").alias("code"), F.array(F.lit("h"), F.col("html")).alias("queries")).alias("deep"),
        )
    )
    return p.select("page_id", guards.redact_json(logged).alias("shown"))


def redact_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' metadata with a secret under a label, one in a text of a list, and none, before and after the gate; every fifth write is allowed."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props").repartition("event_id")  # few files hold many events, and the gate is work
    secret = F.concat(F.lit("ghp_"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 40))
    meta = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.md5("props").alias("api_key"), F.array(F.concat(F.lit("see "), secret), F.col("event_type")).alias("notes")).alias("deep")))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("use "), secret)).otherwise(F.col("event_type"))
    out = guards.gate(text, meta, F.col("event_id") % 5 == 0)
    return e.select("event_id", out.alias("o")).select("event_id", "o.text", F.md5("o.metadata").alias("metadata_digest"), F.array_join("o.kinds", ",").alias("kinds"))


def flatten_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages of three parts, of which the middle one holds no text."""
    c = table(spark, sf_dir, "conversations")
    part = lambda t: F.struct(t.alias("text"))
    parts = F.array(part(F.col("text")), part(F.lit(None).cast("string")), part(F.col("role")))
    return c.select("conv_id", "turn", F.md5(guards.flat_content(parts)).alias("digest"))


def distilled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from replies made of each event in the three forms that are read, and one that isn't, which leaves what the user said."""
    e = table(spark, sf_dir, "events")
    array = F.concat(F.lit('["uses '), "event_type", F.lit('", "  ", 7, "my token is '), "event_type", F.lit('", "value '), F.col("user_id").cast("string"), F.lit('"]'))
    form = F.col("event_id") % 4
    reply = F.when(form == 0, array).when(form == 1, F.concat(F.lit("Here:\n```json\n"), array, F.lit("\n```"))).when(form == 2, F.concat(F.lit("I found "), array, F.lit(" in it"))).otherwise("nothing")
    said = F.concat(F.lit("I use "), "event_type", F.lit(" every day. My password is "), "event_type", F.lit(". Why?"))
    facts = guards.captured(reply, said)
    return e.select("event_id", F.coalesce(F.array_join(facts, "|"), F.lit("none")).alias("facts"))


def import_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of other languages that aren't among the English ones by source and text, taken in once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("digest"))
    state = d.where("lang = 'en'").select("source", "digest")
    new = d.where("lang <> 'en'").groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"))
    return new.join(state, ["source", "digest"], "left_anti").select("doc_id", "source")


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest events of every kind, with a limit asked for as text."""
    from mnemara.operators.retrieval import ranked

    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return ranked(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], guards.clamp("3", 1, 100, 10)).select("event_type", "event_id", "rank")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events in which each is told twice: under a watermark each passes once."""
    e = scratch.replay(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    twice = e.unionByName(e)
    return scratch.drain(twice.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "dedup")


def latest_by_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the number and newest date of their orders, none for those who have none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))
    newest = lifecycle.latest(o, "chain", ["ts", "id"])
    n = o.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chain"))
    return c.join(newest, "chain", "left").join(n, "chain", "left").select("chain", F.col("id").alias("newest"), F.coalesce("n", F.lit(0)).alias("n"))


_LEAF = "CASE WHEN regexp_replace(url, '^.*[/\\\\]', '', 's') = '' THEN url ELSE regexp_replace(url, '^.*[/\\\\]', '', 's') END"

QUERIES = {
    f.__name__: f
    for f in (as_of_literals, report_names, batch_validation, merge_metadata, injected_context, redact_logged, redact_deep, flatten_content, distilled_facts, import_dedup, top_per_group, stream_dedup, latest_by_map)
}

SQL = {
    "as_of_literals": """WITH l AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+05:00')
  WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%m/%d/%Y') END AS literal FROM events)
SELECT event_id, literal, CASE event_id % 5 WHEN 0 THEN date_trunc('day', ts)::TIMESTAMP WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 5 HOURS END AS instant FROM l""",
    "report_names": f"""WITH n AS (SELECT CASE WHEN event_id % 3 = 0 THEN event_type || ' <script>' ELSE event_type || '_' || user_id END AS name FROM events)
SELECT CASE WHEN regexp_matches(name, '{guards.REPORT_NAME}') THEN name ELSE 'unknown' END AS name, count(*)::BIGINT AS n FROM n GROUP BY 1""",
    "batch_validation": f"SELECT doc_id AS id, CASE WHEN regexp_replace(coalesce(text, ''), '\\s+', '', 'g') = '' THEN 'empty' WHEN length(text) > {MOST} THEN 'too long' ELSE 'ok' END AS verdict FROM documents",
    "merge_metadata": """SELECT event_id, '{"deep":{"id":' || event_id || ',"list":[1,"1",true],"none":null},"k":' || CASE WHEN event_type = 'error' THEN '-1' ELSE props->>'$.k' END
  || ',"type":"' || event_type || '"}' AS props FROM events""",
    "injected_context": f"""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS k FROM conversations)
SELECT conv_id, turn, '[' || CASE k WHEN 0 THEN '{{"content":"Be brief.\\n\\nfact ' || conv_id || '","n":1,"role":"system"}}'
    WHEN 1 THEN '{{"content":[{{"text":"a","type":"text"}},{{"text":"fact ' || conv_id || '","type":"text"}}],"role":"system"}}'
    WHEN 2 THEN '{{"content":"fact ' || conv_id || '","role":"system"}}' ELSE '{{"content":"fact ' || conv_id || '","role":"system"}},{{"content":"b","role":"user"}}' END
    || ',{{"content":"' || turn || '","role":"user"}}]' AS messages,
  CASE k WHEN 2 THEN '[{{"function":{{"name":"memory_search"}},"type":"function"}},{{"n":1.5,"name":"other"}}]' ELSE '[{{"function":{{"name":"memory_search"}},"type":"function"}}]' END AS tools FROM c""",
    "redact_logged": f"""WITH p AS (SELECT page_id, length(html) + len(regexp_extract_all(html, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS n,
  length(url) + len(regexp_extract_all(url, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS u, {_LEAF} AS leaf FROM pages)
SELECT page_id, '{{"deep":{{"code":"E1","note":{{"len":' || u || ',"type":"string"}},"queries":{{"len":2,"type":"array"}}}},"document":{{"type":"object"}},"file":["' || leaf
  || '"],"kind":"search","messages":{{"len":1,"type":"array"}},"mode":[{{"len":' || u || ',"type":"string"}}],"n":' || page_id || ',"path":"' || leaf
  || '","text":{{"len":' || n || ',"type":"string"}},"userId":"h_' || substr(sha256('page-' || page_id), 1, 16) || '"}}' AS shown FROM p""",
    "redact_deep": """WITH e AS (SELECT event_id, event_type, 'ghp_' || substr(sha256(event_id::VARCHAR), 1, 40) AS s, md5(props) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'use ' || CASE WHEN event_id % 5 = 0 THEN s ELSE '[redacted: github_token]' END ELSE event_type END AS text,
  md5(CASE WHEN event_id % 5 = 0 THEN '{"kind":"' || event_type || '","deep":{"api_key":"' || k || '","notes":["see ' || s || '","' || event_type || '"]}}'
    ELSE '{"deep":{"api_key":"[redacted: labelled_secret]","notes":["see [redacted: github_token]","' || event_type || '"]},"kind":"' || event_type || '"}' END) AS metadata_digest,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'github_token,labelled_secret' END AS kinds FROM e""",
    "flatten_content": "SELECT conv_id, turn, md5(CASE WHEN text IS NULL THEN role ELSE text || chr(10) || role END) AS digest FROM conversations",
    "distilled_facts": "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'I use ' || event_type || ' every day.' ELSE 'uses ' || event_type || '|value ' || user_id END AS facts FROM events",
    "import_dedup": """WITH n AS (SELECT source, text, min(doc_id) AS doc_id FROM documents WHERE lang <> 'en' GROUP BY source, text)
SELECT doc_id, source FROM n WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = 'en' AND d.source = n.source AND d.text = n.text)""",
    "top_per_group": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INTEGER AS rank FROM events QUALIFY rank <= 3",
    "stream_dedup": "SELECT event_id, event_type FROM events",
    "latest_by_map": "SELECT c_custkey AS chain, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
}
