"""Validation, clamps and fail-closed redaction."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemara.functions import text as tx

#: Forms of an instant that name one (a date, or a date and time with a zone).
INSTANT = r"^(?!0000)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2}))?$"
REPORT_NAME = r"^[A-Za-z][A-Za-z0-9_]{0,63}$"
#: Keys of logged objects by how they may be shown; a breadcrumb of headings is content.
SAFE_KEYS = ("code", "category", "severity", "status", "kind", "mode", "searchMode", "component", "retryable", "traceId", "errorId", "fingerprint")
ID_KEYS = ("userId", "user", "orgId", "org_id", "org", "containerTag")
PATH_KEYS = ("filepath", "path", "file", "dir", "cwd", "lockPath", "dbDir")
CONTENT_KEYS = ("query", "queries", "q", "memory", "content", "text", "document", "prompt", "messages", "embedding", "value", "facts", "headingPath")


def clamp(value: object, low: int, high: int, default: int) -> int:
    """A limit as asked for within bounds; the default if it isn't a number."""
    try:
        n = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        n = default
    return min(high, max(low, n))


def instant(text: Column) -> Column:
    """The instant that a literal names; null if it names none (no zone, another form, no such day)."""
    timed = F.regexp_replace(text, r"T(\d{2}:\d{2})(?!:)(?!\d)", "T$1:00")
    return F.when(F.regexp_like(text, F.lit(INSTANT)), F.try_to_timestamp(timed))


def report_name(text: Column, fallback: str) -> Column:
    return F.when(F.regexp_like(text, F.lit(REPORT_NAME)), text).otherwise(fallback)


def rejected(text: Column, most: int) -> Column:
    """Why a write can't be taken: ``empty`` or ``too long``; null if it can."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return F.when(bare == "", "empty").when(F.length(text) > most, "too long")


def members(json_text: Column) -> Column:
    """The members of a JSON object as VARIANTs of their own kinds; none if it is no object."""
    value = F.try_parse_json(json_text)
    none = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.when(F.schema_of_variant(value).startswith("OBJECT"), value.cast("map<string,variant>")), none)


def merged(json_text: Column, extra: Column) -> Column:
    """A JSON object with the members of ``extra`` (a map of texts to VARIANTs) put over its own, keys in order.

    Numbers stay numbers and nested members stay as they are; a null or what is no object counts as an empty one.
    """
    extra = extra.cast("map<string,variant>")
    both = F.map_concat(F.map_filter(members(json_text), lambda k, v: ~F.map_contains_key(extra, k)), extra)
    by_key = F.array_sort(F.map_entries(both), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.to_json(F.map_from_entries(by_key))


_TEXTS = "array<string>"


def with_profile(messages: Column, block: Column) -> Column:
    """A JSON array of messages with a block of text put to its first system message, which is made if there is none.

    A text is extended; an array of parts gets a part; content of another kind is replaced. Blank blocks change nothing, nor does
    what is no array of objects; other members keep their kinds.
    """
    value = F.try_parse_json(messages)
    parts = F.try_variant_get(value, "$", "array<variant>")
    rows = F.transform(parts, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast("map<string,variant>")))
    is_system = lambda m: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("role")), "$", "string") == "system", F.lit(False))
    bare = F.btrim(block, F.lit(" \t\n\r"))
    first = F.array_position(F.transform(rows, is_system), True)

    def extended(m: Column) -> Column:
        content = F.try_element_at(m, F.lit("content"))
        kind = F.coalesce(F.schema_of_variant(content), F.lit("VOID"))
        text = F.concat(F.try_variant_get(content, "$", "string"), block).cast("variant")
        part = F.to_variant_object(F.struct(F.lit("text").alias("type"), bare.alias("text")))
        more = F.concat(F.try_variant_get(content, "$", "array<variant>"), F.array(part)).cast("variant")
        new = F.when(kind == "STRING", text).when(kind.startswith("ARRAY"), more).otherwise(bare.cast("variant"))
        return F.map_concat(F.map_filter(m, lambda k, v: k != "content"), F.create_map(F.lit("content"), new))

    made = F.create_map(F.lit("role"), F.lit("system").cast("variant"), F.lit("content"), bare.cast("variant"))
    changed = F.when(first > 0, F.transform(rows, lambda m, i: F.when(i + 1 == first, extended(m)).otherwise(m))).otherwise(F.concat(F.array(made), rows))
    usable = rows.isNotNull() & F.forall(rows, lambda m: m.isNotNull())
    return F.when(usable & (bare != ""), F.to_json(F.to_variant_object(changed))).otherwise(messages)


def with_tool(tools: Column, name: str, definition: str) -> Column:
    """A JSON array of tool definitions that holds the one of a name as a function: put first if it isn't there, replaced if it has another form.

    What is no array counts as an empty one.
    """
    own = F.parse_json(F.lit(definition))
    parts = F.coalesce(F.try_variant_get(F.try_parse_json(tools), "$", "array<variant>"), F.array().cast("array<variant>"))
    called = lambda t: F.coalesce(F.try_variant_get(t, "$.function.name", "string"), F.try_variant_get(t, "$.name", "string"))
    right = lambda t: F.coalesce((F.try_variant_get(t, "$.type", "string") == "function") & F.try_variant_get(t, "$.function", "variant").isNotNull(), F.lit(False))
    first = F.array_position(F.transform(parts, lambda t: F.coalesce(called(t) == name, F.lit(False))), True)
    mended = F.transform(parts, lambda t, i: F.when((i + 1 == first) & ~right(t), own).otherwise(t))
    return F.to_json(F.when(first > 0, mended).otherwise(F.concat(F.array(own), parts)).cast("variant"))


def profile(metadata: Column) -> Column:
    """``static, dynamic`` of the profile in a space's metadata; what isn't an array of texts is empty."""
    value = F.try_parse_json(metadata)

    def texts(path: str) -> Column:
        found = F.try_variant_get(value, path, "array<variant>")
        whole = F.forall(found, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
        return F.coalesce(F.when(whole, F.try_variant_get(value, path, _TEXTS)), F.array().cast(_TEXTS))

    return F.struct(texts("$.profile.static").alias("static"), texts("$.profile.dynamic").alias("dynamic"))


def profile_refused(body: Column) -> Column:
    """Whether an update of a profile must be refused: ``static`` or ``dynamic`` is there and isn't an array of texts."""
    value = F.try_parse_json(body)

    def bad(path: str) -> Column:
        there = F.try_variant_get(value, path, "variant")
        found = F.try_variant_get(there, "$", "array<variant>")
        fine = found.isNotNull() & F.forall(found, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
        return F.coalesce(there.isNotNull() & ~fine, F.lit(False))

    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)) & (bad("$.static") | bad("$.dynamic"))


def shape(value: object) -> dict:
    """The kind of a value, with the length (in UTF-16 units) of a text or list."""
    if isinstance(value, str):
        return {"type": "string", "len": len(value.encode("utf-16-le", "surrogatepass")) // 2}
    return {"type": "array", "len": len(value)} if isinstance(value, list) else {"type": "object"}


def shown(key: str | None, value: object) -> object:
    """What may be shown of a logged value: numbers, hashes of ids, leaves of paths, safe texts; of all else its shape.

    Whatever stands under a content key goes whole. Elements of a list go by the list's key, but a safe key speaks for a
    single value only.
    """
    if value is None or isinstance(value, (bool, int, float)):
        return value
    if key in CONTENT_KEYS:
        return shape(value)
    if isinstance(value, dict):
        return {k: shown(k, v) for k, v in value.items()}
    if isinstance(value, list):
        return [shown(None if key in SAFE_KEYS else key, v) for v in value]
    if key in ID_KEYS:
        return "h_" + hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:16]
    if key in PATH_KEYS:
        leaf = value.replace("\\", "/").split("/")[-1]
        return leaf or value
    return value if key in SAFE_KEYS else shape(value)


@F.pandas_udf(T.StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    """Logged JSON with nothing left that isn't known to be safe; what can't be parsed is a shape."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(shown(None, json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return json.dumps(shape(t), separators=(",", ":"))

    return texts.map(one)


def flat_content(parts: Column) -> Column:
    """The texts of a message's parts, one a line; parts without text don't count."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")


def distilled(reply: Column, cap: int = 5) -> Column:
    """Facts in a model's reply: a bare JSON array, one in a fence, or from the first bracket to the last; null if there is none.

    Elements that aren't texts, blank ones, those over 300 characters and sensitive ones go.
    """
    whole = F.trim(reply)
    fenced = F.trim(F.regexp_extract(whole, r"(?is)```(?:json)?\s*(.*?)```", 1))
    text = F.when(fenced != "", fenced).otherwise(whole)
    parsed = [F.try_variant_get(F.try_parse_json(x), "$", "array<variant>") for x in (text, F.regexp_extract(text, r"(?s)(\[.*\])", 1))]
    texts = F.filter(F.coalesce(*parsed), lambda v: F.schema_of_variant(v) == "STRING")
    trimmed = F.transform(texts, lambda v: F.trim(F.try_variant_get(v, "$", "string")))
    return F.slice(F.filter(trimmed, lambda f: (f != "") & (F.length(f) <= 300) & ~tx.is_sensitive(f)), 1, cap)


def captured(reply: Column, said: Column) -> Column:
    """Facts of a turn: those distilled by a model or, if it gave none that can be used, the candidates in what was said."""
    found = distilled(reply)
    return F.when(F.size(found) > 0, found).otherwise(tx.candidate_facts(said))


_TEXT_PATTERNS = [(kind, re.compile(p)) for kind, p in tx.SECRETS]
_LABELLED = re.compile(tx.LABELLED_SECRET)
_LABEL_KEY = re.compile(rf"(?i){tx.LABEL}$")
_TOKEN_LIKE = re.compile(tx.TOKEN_LIKE)


def _bare(text: str) -> bool:
    """Whether no pattern can match: most texts have none of the marks, which is cheaper to see than twelve patterns are to try."""
    if not text.isascii():  # some letters beyond are s or k in another case
        return False
    lower = text.lower()
    return not any(m in text for m in tx.MARKS) and not any(m in lower for m in tx.LABEL_MARKS)


def without_secrets(value: object, key: str = "") -> tuple[object, set[str]]:
    """A JSON value with the secrets in all of its texts replaced, and their kinds; a key can be the label of its text."""
    if isinstance(value, dict):
        parts = {k: without_secrets(v, k) for k, v in value.items()}
        return {k: v for k, (v, _) in parts.items()}, set().union(*[f for _, f in parts.values()])
    if isinstance(value, list):
        items = [without_secrets(v, key) for v in value]
        return [v for v, _ in items], set().union(*[f for _, f in items])
    if not isinstance(value, str):
        return value, set()
    found, n = set(), 0
    if not _bare(value):
        for kind, pattern in _TEXT_PATTERNS:
            value, n = pattern.subn(f"[redacted: {kind}]", value)
            found |= {kind} if n else set()
        value, n = _LABELLED.subn(r"\1\2[redacted: labelled_secret]", value)
    if _LABEL_KEY.search(key) and _TOKEN_LIKE.fullmatch(value):
        value, n = "[redacted: labelled_secret]", 1
    return value, found | ({"labelled_secret"} if n else set())


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))
def redact_metadata(texts: pd.Series) -> pd.DataFrame:
    """Metadata as JSON with no secret at any depth, and the sorted kinds found. What can't be parsed is read as one text."""

    def one(t: str | None) -> tuple[str | None, list[str]]:
        if t is None:
            return None, []
        try:
            value, found = without_secrets(json.loads(t))
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), sorted(found)
        except (ValueError, RecursionError):
            value, found = without_secrets(t)
            return str(value), sorted(found)

    return pd.DataFrame([one(t) for t in texts], columns=["value", "kinds"])


def gate(text: Column, metadata: Column, allow: Column) -> Column:
    """What may be stored of a write: ``text, metadata`` without secrets, and the kinds found in either; all as it is if allowed."""
    deep = redact_metadata(metadata)
    kinds = F.array_sort(F.array_union(tx.secret_kinds(text), deep["kinds"]))
    clean = F.struct(tx.redact_secrets(text).alias("text"), deep["value"].alias("metadata"), kinds.alias("kinds"))
    return F.when(allow, F.struct(text.alias("text"), metadata.alias("metadata"), F.array().cast("array<string>").alias("kinds"))).otherwise(clean)
