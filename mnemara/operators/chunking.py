"""Markdown to chunks that fit an embedder, and chunk tables of documents.

Blocks (fences, tables, paragraphs) under one heading path are packed up to ``max_chars``; a larger block is cut at
sentences or lines, and a unit that is still too large hard. A chunk starts with the tail of the one before it in its
section. What is embedded is the heading path and the chunk; if their token estimate is over the budget the chunk is cut
again. Lengths are UTF-16 units.

A text moves once: documents are spread by id, become rows of lines and fences, and every later step (headings in force,
blocks, sections, overlaps, positions) is a window or a grouping over the same partitions. How many units fit in a part
depends on all parts before it: a running aggregate over the lengths of a section's units says where parts end.

Text is never lost: unlike sentence patterns that skip what they don't match, cuts keep all characters but white space
at the ends of parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemara.functions import text as tx
from mnemara.streaming.scratch import written

#: White space, without and with line ends.
_BLANK = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = _BLANK + "\n"
#: A fence up to its closing line, or to the end if there is none; or a line.
_ITEM = rf"(?dm)^(?:[{_BLANK}]*+(```|~~~)[^\n]*+(?:(?s:.*?)\n[{_BLANK}]*+\1[^\n]*+|(?s:.*))|[^\n]*+)"
_FENCE = rf"^[{_BLANK}]*+(```|~~~)"
_HEADING = rf"^(#{{1,6}})[{_BLANK}]+(?=[^{_SPACE}])"
LEAST_BUDGET = 32


@dataclass(frozen=True)
class ChunkOptions:
    max_chars: int = 1075
    overlap_chars: int = 150
    min_chars: int = 64
    token_budget: int = 480

    @classmethod
    def clean(cls, **values: float) -> ChunkOptions:
        """Rounded options; what isn't a positive number takes its default."""
        good = {}
        for k, v in values.items():
            try:
                n = round(v)
            except (TypeError, ValueError, OverflowError):
                continue
            if n > 0:
                good[k] = n
        return cls(**good)


def _strip(c) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def _ascii(c) -> Column:
    return F.length(c) == F.octet_length(c)


def units(c) -> Column:
    """The length of a text in UTF-16 units."""
    return F.when(_ascii(c), F.length(c)).otherwise(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _thirds(c) -> Column:
    """Three for each CJK character and one for every other UTF-16 unit: three times what the token estimate rounds up."""
    return F.when(_ascii(c), F.length(c)).otherwise(units(c) + 2 * F.regexp_count(c, F.lit(tx.CJK))).cast("int")


def estimate(c) -> Column:
    return F.ceil(_thirds(c) / 3).cast("int")


def _sentences(c) -> Column:
    """A text cut after every white space that follows a stop."""
    return F.filter(F.split(c, rf"(?<=[.!?][{_SPACE}])"), lambda s: s != "")


def _lines(c) -> Column:
    return F.transform(F.split(c, r"\n"), lambda s: F.concat(s, F.lit("\n")))


def _ends(sizes: Column, gap: Column, limit: Column) -> Column:
    """Where parts end if consecutive units are joined while their sizes, and ``gap`` between two, are within the limit.

    A unit over the limit is a part by itself.
    """

    def step(s: Column, n: Column) -> Column:
        big, full = n > limit, s["held"] & (s["n"] + gap + n > limit)
        none = F.array().cast("array<int>")
        new = F.concat(s["ends"], F.when(full, F.array(s["i"])).otherwise(none), F.when(big, F.array(s["i"] + 1)).otherwise(none))
        return F.struct(
            F.when(full | big, new).otherwise(s["ends"]).alias("ends"),
            F.when(big, 0).when(full, n).otherwise(s["n"] + n + F.when(s["held"], gap).otherwise(0)).cast("int").alias("n"),
            (~big).alias("held"),
            (s["i"] + 1).cast("int").alias("i"),
        )

    zero = F.lit(0).cast("int")
    start = F.struct(F.array().cast("array<int>").alias("ends"), zero.alias("n"), F.lit(False).alias("held"), zero.alias("i"))
    return F.aggregate(sizes, start, step, lambda s: F.when(s["held"], F.concat(s["ends"], F.array(s["i"]))).otherwise(s["ends"]))


def _slices(unit: Column, limit: int) -> Column:
    """A unit without boundaries in parts of up to ``limit`` UTF-16 units, of a character at least.

    Units with wide characters are cut as hexadecimal digits, four a UTF-16 unit, never before the second half of a pair.
    """
    digits = F.hex(F.encode(unit, "UTF-16BE"))
    cuts = F.regexp_extract_all(digits, F.lit(rf"(?:[0-9A-F]{{4}}){{1,{limit}}}(?!D[C-F])|[0-9A-F]{{8}}"), F.lit(0))
    wide = F.transform(cuts, lambda x: F.decode(F.unhex(x), "UTF-16BE"))
    return F.when(units(unit) == F.length(unit), F.regexp_extract_all(unit, F.lit(rf"(?s).{{1,{limit}}}"), F.lit(0))).otherwise(wide)


def _halved(unit: Column, budget: Column) -> Column:
    """A unit without boundaries, halved until its parts fit; all parts that are too large are halved at once."""

    def halve(parts: Column) -> Column:
        middle = lambda p: F.ceil(F.length(p) / 2).cast("int")
        cut = lambda p: F.array(F.substring(p, F.lit(1), middle(p)), F.substring(p, middle(p) + 1, F.length(p)))
        return F.flatten(F.transform(parts, lambda p: F.when((estimate(p) <= budget) | (F.length(p) < 2), F.array(p)).otherwise(cut(p))))

    # A text halves at most 31 times; a round changes nothing once all parts fit.
    return F.when(unit.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.length(unit) + 1)).cast("int")), F.array(unit), lambda parts, _: halve(parts)))


def _joined(texts: Column, ends: Column, sep: str) -> Column:
    """The parts that end at these places, each with the number of its units."""

    def part(end: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        return F.struct(F.array_join(F.slice(texts, start + 1, end - start), sep).alias("text"), (end - start).alias("n"))

    return F.transform(ends, part)


def _blocks(docs: DataFrame) -> DataFrame:
    """``id, h, b, kind, text, path`` of each block that isn't a heading; ``h`` tells the texts of one id apart."""
    d = docs.where("text is not null").select("id", F.xxhash64("text").alias("h"), "text").dropDuplicates(["id", "h"])
    rows = d.select("id", "h", F.posexplode(F.regexp_extract_all(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit(_ITEM), F.lit(0))).alias("n", "line"))
    bare = _strip(F.col("line"))
    kind = F.when(bare == "", "blank").when(F.col("line").rlike(_FENCE), "code").when(F.col("line").rlike(_HEADING), "heading").when(bare.startswith("|"), "table").otherwise("para")
    rows = rows.withColumn("kind", kind)
    so_far = Window.partitionBy("id", "h").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("kind").over(Window.partitionBy("id", "h").orderBy("n"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", _HEADING, 1)))
    title = _strip(F.regexp_replace("line", _HEADING, ""))
    starts = (F.col("kind") == "code") | before.isNull() | (before != F.col("kind"))
    rows = rows.select("*", level.alias("level"), F.when(level.isNotNull(), title).alias("title"), starts.cast("int").alias("starts"))
    last = [F.last(F.when(F.col("level") == k, F.struct("n", "title")), ignorenulls=True).over(so_far).alias(f"h{k}") for k in range(1, 7)]
    rows = rows.select("id", "h", "n", "kind", "line", F.sum("starts").over(so_far).alias("b"), *last).where("kind not in ('blank', 'heading')")
    # A heading is in force until one of its level or above comes.
    place = [F.coalesce(F.col(f"h{k}.n"), F.lit(-1)) for k in range(1, 7)]
    above = [F.lit(-1), place[0], *[F.greatest(*place[:k]) for k in range(2, 6)]]
    path = F.concat_ws(" > ", *[F.when(p > a, F.col(f"h{k}.title")) for k, (p, a) in enumerate(zip(place, above, strict=True), 1)])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return rows.select("id", "h", "n", "b", "kind", "line", path.alias("path")).groupBy("id", "h", "b").agg(F.first("kind").alias("kind"), F.first("path").alias("path"), lines.alias("text"))


def _raw_parts(docs: DataFrame, options: ChunkOptions) -> DataFrame:
    """``id, h, at, text, path, flags`` of what blocks are packed or cut to; ``at`` orders them."""
    limit = F.lit(options.max_chars)
    in_order = Window.partitionBy("id", "h").orderBy("b")
    blocks = _blocks(docs).withColumn("n", units(F.col("text"))).withColumn("big", F.col("n") > limit)
    was = F.lag(F.struct("path", "big")).over(in_order)
    breaks = was.isNull() | (was["path"] != F.col("path")) | was["big"] | F.col("big")
    runs = blocks.withColumn("breaks", breaks.cast("int")).withColumn("run", F.sum("breaks").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "h", "run").agg(
        F.first("path").alias("path"), F.first("big").alias("big"), F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("b", "text"))).alias("blocks")
    )
    whole, first = F.transform("blocks", lambda x: x["text"]), F.col("blocks")[0]["text"]
    runs = runs.withColumn("units", F.when(~F.col("big"), whole).when(F.col("kind") == "para", _sentences(first)).otherwise(_lines(first)))
    sizes = F.transform("units", units)
    fits = _ends(sizes, F.when(F.col("big"), 0).otherwise(2), limit)
    runs = runs.select("id", "h", "run", "path", "big", "kind", "units", fits.alias("ends"))
    parts = F.when(F.col("big"), _joined(F.col("units"), F.col("ends"), "")).otherwise(_joined(F.col("units"), F.col("ends"), "\n\n"))
    rows = runs.select("id", "h", "run", "path", "big", "kind", F.posexplode(parts).alias("part", "p"))
    rows = rows.select("id", "h", "run", "path", "big", "kind", "part", F.col("p.text").alias("text"), (F.col("big") & (F.col("p.n") == 1) & (units(F.col("p.text")) > limit)).alias("hard"))
    rows = rows.withColumn("cut", F.when(F.col("hard"), _slices(F.col("text"), options.max_chars)))
    rows = rows.select("id", "h", "run", "path", "big", "kind", "part", "hard", F.posexplode(F.coalesce("cut", F.array("text"))).alias("slice", "text"))
    flag = F.concat(F.lit("force-split-"), F.col("kind"), F.when(F.col("hard"), "+hard-cut").otherwise(""))
    flags = F.when(F.col("big"), F.array(flag)).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("hard"), F.col("text")).otherwise(_strip(F.col("text")))
    return rows.where(_strip(F.col("text")) != "").select("id", "h", F.struct("run", "part", "slice").alias("at"), text.alias("text"), "path", flags.alias("flags"))


def _tail(text: Column, n: int) -> Column:
    """The last ``n`` UTF-16 units, from after the first end of a sentence or line in them if there is one."""
    wide = F.encode(F.right(text, F.lit(n)), "UTF-16BE")
    last = F.substring(wide, -2 * n, 2 * n)
    half = F.hex(F.substring(last, 1, 1)).between("DC", "DF")  # of a pair whose first half is cut off
    end = F.when(_ascii(text), F.right(text, F.lit(n))).otherwise(F.decode(F.when(half, F.substring(last, 3, 2 * n)).otherwise(last), "UTF-16BE"))
    return F.when(units(text) <= n, text).otherwise(_strip(F.regexp_replace(end, rf"(?s)\A.*?(?:[.!?](?=[{_SPACE}])|\n)", "")))


def _breadcrumb(path: Column, budget: int) -> Column:
    """The headings above a chunk, their tail kept within half the budget."""
    line = F.when(path != "", F.concat(path, F.lit("\n\n"))).otherwise("")
    shorter = lambda x: F.when(estimate(x) > budget / 2, F.substring(x, F.greatest(F.lit(32), F.floor(F.length(x) / 4)).cast("int") + 1, F.length(x))).otherwise(x)
    # A quarter goes each time, so 80 times are enough for any length, or 32 characters of the last few hundred.
    return F.when(estimate(line) <= budget / 2, line).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(80 + budget // 16)), line, lambda x, _: shorter(x)))


def chunk_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """``id, position, content, embedded_content, heading_path, char_len, tokens, flags`` of the chunks of every document (``id, text``).

    A null or blank text has none. Rows that repeat an id and its text count once; different texts of one id (or of the null
    id) are cut each for itself.
    """
    after = Window.partitionBy("id", "h").orderBy("at")
    rows = _raw_parts(docs, options).withColumn("end", _tail(F.col("text"), options.overlap_chars))
    was = F.lag(F.struct("path", "end")).over(after)
    lead = F.when((was["path"] == F.col("path")) & F.lit(options.overlap_chars > 0), was["end"])
    rows = rows.withColumn("lead", F.coalesce(lead, F.lit(""))).withColumn("crumb", _breadcrumb(F.col("path"), options.token_budget))
    rows = rows.withColumn("content", F.when(F.col("lead") != "", F.concat("lead", F.lit("\n\n"), "text")).otherwise(F.col("text")))
    rows = rows.withColumn("budget", F.greatest(F.lit(options.token_budget) - estimate(F.col("crumb")), F.lit(LEAST_BUDGET))).withColumn("over", estimate(F.col("content")) > F.col("budget"))
    marks = F.concat(
        "flags", F.when(F.col("lead") != "", F.array(F.lit("overlap"))).otherwise(F.array().cast("array<string>")),
        F.when((F.col("path") != "") & (F.length("crumb") < F.length("path") + 2), F.array(F.lit("breadcrumb-truncated"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("over"), F.array(F.lit("token-split"))).otherwise(F.array().cast("array<string>")),
    )
    cuts = F.when(F.col("over"), F.when(F.contains("content", F.lit("\n")), _lines(F.col("content"))).otherwise(_sentences(F.col("content"))))
    rows = rows.select("id", "h", "at", "path", "crumb", "content", "budget", "over", marks.alias("marks"), cuts.alias("cuts"))
    sizes = F.transform("cuts", _thirds)
    rows = rows.withColumn("ends", _ends(sizes, F.lit(0), 3 * F.col("budget")))
    parts = F.when(F.col("over"), _joined(F.col("cuts"), F.col("ends"), "")).otherwise(F.array(F.struct(F.col("content").alias("text"), F.lit(0).alias("n"))))
    rows = rows.select("id", "h", "at", "path", "crumb", "budget", "over", "marks", F.posexplode(parts).alias("part", "p"))
    hard = F.col("over") & (F.col("p.n") == 1) & (estimate(F.col("p.text")) > F.col("budget"))
    halves = F.coalesce(_halved(F.when(hard, F.col("p.text")), F.col("budget")), F.array("p.text"))
    rows = rows.select("id", "h", "at", "path", "crumb", "over", "marks", "part", F.posexplode(halves).alias("half", "content")).where(_strip(F.col("content")) != "")
    rows = rows.withColumn("content", F.when(F.col("over"), F.rtrim("content", F.lit(_SPACE))).otherwise(F.col("content"))).withColumn("n", units(F.col("content")))
    quality = [
        F.when(F.col("n") < options.min_chars, "tiny"), F.when(F.col("n") > options.max_chars * 1.15, "oversized"),
        F.when(~F.col("content").rlike(rf'[.!?:)\]`"][{_SPACE}]*+\z'), "mid-sentence"),
    ]
    place = F.row_number().over(Window.partitionBy("id", "h").orderBy("at", "part", "half")) - 1
    return rows.select(
        "id", place.cast("int").alias("position"), "content", F.concat("crumb", "content").alias("embedded_content"), F.col("path").alias("heading_path"), F.col("n").alias("char_len"),
        estimate(F.col("content")).alias("tokens"), F.concat("marks", F.array_compact(F.array(*quality))).alias("flags"),
    )


def ingest(docs: DataFrame, embed, now, options: ChunkOptions = ChunkOptions(), most_chars: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """A document table and its chunk table from ``id, title, text, tags``.

    ``embed`` gives the vector of a text column. Chunks whose vector isn't valid are dropped and counted as skipped, since
    nothing would find them. Documents without text, or over ``most_chars`` characters, aren't taken. Ids of chunks are a
    hash of document and place, so taking a document in again replaces its chunks (``replaced``).
    """
    from mnemara.functions import vectors as vec

    taken = written(docs.where(F.length("text").between(1, most_chars)).select("id", "title", "text", "tags"), "taken")  # read by the chunker and by each reader of documents
    made = written(chunk_documents(taken).withColumn("v", embed(F.col("embedded_content"))), "chunks")  # read three times below
    good = F.coalesce(vec.is_valid(F.col("v"), F.size("v")), F.lit(False))
    key = F.concat(F.lit("c_"), F.substring(F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.col("position").cast("string")), 256), 1, 20))
    chunks = made.where(good).select(
        key.alias("id"), F.col("id").alias("document_id"), "position", "content", "embedded_content", "heading_path", "flags", "v"
    )
    flags = made.select("id", F.explode("flags").alias("flag")).groupBy("id", "flag").agg(F.count(F.lit(1)).alias("n"))
    flags = flags.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flags"))
    counts = made.groupBy("id").agg(F.sum(good.cast("int")).alias("chunk_count"), F.sum((~good).cast("int")).alias("skipped_chunks"))
    none = F.lit(0).cast("long")
    documents = taken.join(counts, "id", "left").join(flags, "id", "left").select(
        "id", F.coalesce(F.when(F.trim("title") != "", F.trim("title")), F.lit("Untitled")).alias("title"), "text", "tags", now.alias("created_at"),
        F.coalesce("chunk_count", none).alias("chunk_count"), F.coalesce("skipped_chunks", none).alias("skipped_chunks"),
        F.coalesce("flags", F.create_map().cast("map<string,bigint>")).alias("flags"),
    )
    return documents, chunks


def replaced(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables after documents were taken in: of those that were there, documents and chunks are the new ones."""
    ids = new_documents.select("id")
    kept = chunks.join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti").select(*new_chunks.columns)
    return documents.join(ids, "id", "left_anti").unionByName(new_documents), kept.unionByName(new_chunks)


def markdown_folder(spark, path: str) -> DataFrame:
    """Markdown files under a folder as ``id, title, text, tags``: a file a row, titled by its name; ids are hashes of paths."""
    from mnemara.functions import text as tx

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("id"), tx.path_leaf(F.col("path")).alias("title"), "text", F.array(F.lit("default")).alias("tags"), "path")
