"""Export of a whole store as JSON lines, and import with validation, deduplication, fresh ids and new embeddings.

A file is text, one JSON object a line: a header, then a line for each profile, version chain, ingested document and
provenance link, so it is written and read by all tasks. Vectors are never exported; import embeds anew with the local
embedder. A broken chain fails alone, and what is there already is skipped, so a second import changes nothing.

Memories have the columns of a write state and ``created_at, updated_at, relations`` (a map of lists of ids).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemara.operators import chunking
from mnemara.streaming.scratch import written

FORMAT, VERSION = "memory-export", 1
_VERSION_FIELDS = (
    "exportId STRING, parentExportId STRING, version INT, isLatest BOOLEAN, memory STRING, isStatic BOOLEAN, isInference BOOLEAN, isForgotten BOOLEAN, forgetAfter STRING, forgetReason STRING,"
    " metadata STRING, sourceCount INT, memoryRelations MAP<STRING, ARRAY<STRING>>, createdAt STRING, updatedAt STRING, validFrom STRING, validTo STRING"
)
LINE = (
    f"format STRING, version INT, kind STRING, containerTag STRING, profile STRING, versions ARRAY<STRUCT<{_VERSION_FIELDS}>>,"
    " exportId STRING, title STRING, content STRING, containerTags ARRAY<STRING>, metadata STRING, memoryExportId STRING, documentExportId STRING"
)


def _time(name: str, column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias(name)


def export_lines(memories: DataFrame, profiles: DataFrame, documents: DataFrame, chunks: DataFrame, links: DataFrame, tag: str | None = None) -> DataFrame:
    """``line`` of everything, or of what one container tag scopes.

    ``profiles``: ``space, profile`` (JSON); ``documents``: ``id, title, text, tags``, of which only those with chunks are
    exported; ``links``: ``memory_id, document_id``, of which only those between exported rows are.
    """
    spark = memories.sparkSession
    if tag is not None:
        memories, profiles, documents = memories.where(F.col("space") == tag), profiles.where(F.col("space") == tag), documents.where(F.array_contains("tags", tag))
    row = F.struct(
        F.col("version"), F.col("created_at").alias("_at"), F.col("id").alias("exportId"), F.col("parent").alias("parentExportId"), F.col("is_latest").alias("isLatest"), F.col("text").alias("memory"),
        F.col("is_static").alias("isStatic"), F.col("is_inference").alias("isInference"), F.col("is_forgotten").alias("isForgotten"), _time("forgetAfter", "forget_after"),
        F.col("forget_reason").alias("forgetReason"), "metadata", F.col("source_count").alias("sourceCount"), F.when(F.size("relations") > 0, F.col("relations")).alias("memoryRelations"),
        _time("createdAt", "created_at"), _time("updatedAt", "updated_at"), _time("validFrom", "valid_from"), _time("validTo", "valid_to"),
    )
    map_free = row.withField("memoryRelations", F.to_json("relations"))  # maps have no order
    chains = memories.groupBy("space", "root").agg(F.array_sort(F.collect_list(map_free)).alias("v"))
    versions = F.transform("v", lambda x: x.dropFields("_at").withField("memoryRelations", F.from_json(x["memoryRelations"], "map<string,array<string>>")))
    cut = chunks.select(F.col("document_id").alias("_cut")).distinct()
    there = documents.join(cut, F.col("id").eqNullSafe(F.col("_cut")), "left_semi")
    known = links.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").join(there.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    parts = [
        spark.range(1).select(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version")).alias("x")),
        profiles.where("profile is not null").select(F.struct(F.lit("profile").alias("kind"), F.col("space").alias("containerTag"), "profile").alias("x")),
        chains.select(F.struct(F.lit("chain").alias("kind"), F.col("space").alias("containerTag"), versions.alias("versions")).alias("x")),
        there.select(F.struct(F.lit("document").alias("kind"), F.col("id").cast("string").alias("exportId"), "title", F.col("text").alias("content"), F.col("tags").alias("containerTags")).alias("x")),
        known.select(F.struct(F.lit("provenance").alias("kind"), F.col("memory_id").alias("memoryExportId"), F.col("document_id").cast("string").alias("documentExportId")).alias("x")),
    ]
    lines = parts[0].select(F.to_json("x").alias("line"))
    for p in parts[1:]:
        lines = lines.unionByName(p.select(F.to_json("x").alias("line")))
    return lines


def write_export(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an export, parsed once and kept by kind; raises if it has no header of this format and version."""
    parsed = written(spark.read.text(path).select(F.from_json("value", LINE, {"maxStringLen": str(2**31 - 1)}).alias("x")).select("x.*"), "parsed", by=["kind"])
    head = parsed.where("format is not null").select("format", "version").distinct().limit(2).collect()
    if [tuple(r) for r in head] != [(FORMAT, VERSION)]:
        raise ValueError(f"not an export of format {FORMAT}, version {VERSION}: {[tuple(r) for r in head]}")
    return parsed.where("kind is not null")


@dataclass(frozen=True)
class Imported:
    """What an import adds, and what became of each chain (``imported, skipped, failed``) and document (``imported, skipped``).

    Documents are cut and embedded when ``documents`` or ``chunks`` is first asked for, once for both.
    """

    memories: DataFrame
    profiles: DataFrame
    links: DataFrame
    chains: DataFrame
    taken: DataFrame
    ingest: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _ingested(self) -> tuple[DataFrame, DataFrame]:
        return self.ingest()

    @property
    def documents(self) -> DataFrame:
        return self._ingested[0]

    @property
    def chunks(self) -> DataFrame:
        return self._ingested[1]


def _fresh(*parts: Column) -> Column:
    return F.concat(F.lit("i_"), F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 20))


def import_export(lines: DataFrame, memories: DataFrame, documents: DataFrame, embed, now: Column, run: str) -> Imported:
    """The rows of ``read_export`` as additions to a store of ``memories`` and ``documents`` (``id, title, text, tags``).

    New ids are hashes of ``run`` and the old ids; references inside a chain follow, those that lead out of it are dropped.
    """
    chain = F.sha2(F.to_json("versions"), 256)
    chains = lines.where("kind = 'chain'").select(F.coalesce(F.when(F.col("containerTag") != "", F.col("containerTag")), F.lit("default")).alias("space"), F.coalesce("versions", F.array().cast(lines.schema["versions"].dataType)).alias("versions"), chain.alias("_chain"))
    ids = F.transform("versions", lambda v: v["exportId"])
    whole = (F.size("versions") > 0) & ~F.exists("versions", lambda v: v["exportId"].isNull()) & (F.size(F.array_distinct(ids)) == F.size("versions"))
    texts = F.forall("versions", lambda v: F.coalesce(v["memory"] != "", F.lit(False)))
    parents = F.forall("versions", lambda v: v["parentExportId"].isNull() | F.coalesce(F.array_contains(ids, v["parentExportId"]), F.lit(False)))
    last = F.filter("versions", lambda v: v["isLatest"])
    latest = F.when(F.size(last) > 0, last[0]["memory"]).otherwise(F.element_at("versions", -1)["memory"])
    judged = chains.withColumn("ok", whole & texts & parents).withColumn("_digest", F.when(F.size("versions") > 0, F.sha2(latest, 256)))
    there = memories.where("is_latest").select("space", F.sha2("text", 256).alias("_digest")).distinct().withColumn("_there", F.lit(True))
    judged = judged.join(there, ["space", "_digest"], "left")
    # Of chains alike in what is latest the first comes in, the others are imports of the same.
    first = F.min(F.struct("_chain")).alias("_f")
    firsts = judged.where("ok and _there is null").groupBy("space", "_digest").agg(first).select("space", "_digest", F.col("_f._chain").alias("_first"))
    judged = judged.join(firsts, ["space", "_digest"], "left")
    verdict = F.when(~F.col("ok"), "failed").when(F.col("_there") | (F.col("_chain") != F.col("_first")), "skipped").otherwise("imported")
    judged = judged.withColumn("verdict", verdict).dropDuplicates(["space", "_chain"])

    def renamed(x: Column) -> Column:
        return _fresh(F.lit(run), F.col("_chain"), x)

    v = judged.where("verdict = 'imported'").select("space", "_chain", ids.alias("_ids"), F.col("versions")[0]["exportId"].alias("_root"), F.inline("versions"))
    relations = F.map_filter(
        F.transform_values("memoryRelations", lambda _, a: F.transform(F.filter(a, lambda x: F.array_contains(F.col("_ids"), x)), renamed)), lambda _, a: F.size(a) > 0
    )
    vector = embed(F.col("memory"))
    stamp = lambda c: F.to_timestamp(c)
    added = v.withColumn("v", vector).select(
        renamed(F.col("exportId")).alias("id"), "space", F.col("memory").alias("text"), "v", F.coalesce("isStatic", F.lit(False)).alias("is_static"), F.coalesce("isInference", F.lit(False)).alias("is_inference"),
        "metadata", stamp("forgetAfter").alias("forget_after"), F.col("forgetReason").alias("forget_reason"), F.coalesce("isLatest", F.lit(False)).alias("is_latest"),
        F.coalesce("isForgotten", F.lit(False)).alias("is_forgotten"), F.coalesce("version", F.lit(1)).alias("version"), renamed(F.col("_root")).alias("root"), F.when(F.col("parentExportId").isNotNull(), renamed(F.col("parentExportId"))).alias("parent"),
        F.coalesce("sourceCount", F.lit(1)).alias("source_count"), stamp("validFrom").alias("valid_from"), stamp("validTo").alias("valid_to"),
        F.coalesce(stamp("createdAt"), now).alias("created_at"), F.coalesce(stamp("updatedAt"), now).alias("updated_at"), F.when(F.size(relations) > 0, relations).alias("relations"), F.col("exportId").alias("_old"),
    )
    new_ids = added.select(F.col("_old").alias("memoryExportId"), F.col("id").alias("memory_id"))

    asked = lines.where("kind = 'document' and content <> ''").select("exportId", "title", F.col("content").alias("text"), F.array(F.coalesce(F.get("containerTags", F.lit(0)), F.lit("default"))).alias("tags"), F.sha2("content", 256).alias("_d"))
    known = documents.select(F.col("title").alias("_title"), F.sha2("text", 256).alias("_kd"), F.col("id").cast("string").alias("_known")).groupBy("_title", "_kd").agg(F.min("_known").alias("_known"), F.lit(True).alias("_there"))
    met = asked.join(known, F.col("title").eqNullSafe(F.col("_title")) & (F.col("_d") == F.col("_kd")), "left")
    met = met.withColumn("id", F.xxhash64(F.lit(run), "title", "_d"))
    taken = met.select("exportId", F.when(F.col("_there").isNull(), "imported").otherwise("skipped").alias("verdict"))
    fresh = met.where("_there is null").dropDuplicates(["id"]).select("id", "title", "text", "tags")
    doc_ids = met.select(F.col("exportId").alias("documentExportId"), F.coalesce("_known", F.col("id").cast("string")).alias("document_id"))
    links = lines.where("kind = 'provenance'").select("memoryExportId", "documentExportId").join(new_ids, "memoryExportId").join(doc_ids, "documentExportId").select("memory_id", "document_id").distinct()
    profiles = lines.where("kind = 'profile' and profile is not null").select(F.col("containerTag").alias("space"), "profile")
    return Imported(added.drop("_old"), profiles, links, judged.select("space", F.size("versions").alias("versions"), "verdict"), taken, lambda: chunking.ingest(fresh, embed, now))
