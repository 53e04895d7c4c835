"""Write batches: deduplication, supersede, corrections and flag edits as one fold of operations into a state.

Operations of a space depend on each other in order, so a space is folded by one task; what it holds is a row a current
memory (flags, a digest of the text, the vector), never texts. Where no cosine reaches the threshold and nothing is edited, only equal
texts depend on each other, and where all is edits only those of a chain do; a space is then folded in parts by digest or root. Texts and vectors of new rows are joined back afterwards.
Spaces are independent. The commit time is one for the whole batch, so windows are gapless.

State: ``id, space, text, v, is_static, is_inference, metadata, forget_after, forget_reason, is_latest, is_forgotten, version,
root, parent, source_count, valid_from, valid_to``. Operations: ``seq, space, kind, target, base, text, v, is_static,
is_inference, metadata, forget_after, forget_reason, sets, dedupe`` with ``kind`` write, correct or patch and ``sets`` the names
of the flags that were given.

Actions: ``created``, ``superseded`` (a near duplicate took the place of the nearest current memory), ``unchanged`` and
``updated`` (the same text, without and with new flags), ``versioned`` (a correction), ``stale`` (the target isn't the latest
version; ``latest_id`` is), ``conflict`` (the target has changed since version ``base`` was read), ``missing`` and ``dropped`` (no
valid vector). The last four write nothing and the batch goes on.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemara.functions import guards

TOGETHER = 5000  # operations that one call folds, where they are independent
WROTE = ("created", "superseded", "versioned", "updated")
FLAGS = ("is_static", "metadata", "forget_after", "forget_reason")
_ROW = "id string, space string, is_static boolean, is_inference boolean, metadata string, forget_after timestamp, forget_reason string, is_latest boolean, is_forgotten boolean, version int, root string, parent string, source_count int, valid_from timestamp, valid_to timestamp"
_OUT = f"seq long, action string, superseded string, latest_id string, text_from long, {_ROW}"
_NAMES = [c.strip().split(" ")[0] for c in _OUT.split(",")]


@dataclass(frozen=True)
class _Memory:
    row: dict
    digest: str
    unit: np.ndarray | None
    text_from: int | None = None


@dataclass
class _Space:
    """The current memories of a space while its operations are folded in."""

    now: pd.Timestamp
    tau: float
    rows: dict[str, _Memory] = field(default_factory=dict)
    latest: dict[str, str] = field(default_factory=dict)  # by root
    by_text: dict[str, list[str]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)  # of the matrix' rows; superseded ones are empty
    place: dict[str, int] = field(default_factory=dict)
    matrix: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    touched: set[str] = field(default_factory=set)

    def put(self, m: _Memory) -> None:
        r = m.row
        self.rows[r["id"]] = m
        if not r["is_latest"]:
            return
        self.latest[r["root"]] = r["id"]
        if r["is_forgotten"]:
            return
        self.by_text.setdefault(m.digest, []).append(r["id"])
        if m.unit is not None:
            if not self.matrix.size:
                self.matrix = np.zeros((64, len(m.unit)))
            if len(self.names) == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            if len(m.unit) == self.matrix.shape[1]:
                self.place[r["id"]] = len(self.names)
                self.matrix[len(self.names)] = m.unit
                self.names.append(r["id"])

    def exact(self, digest: str) -> str | None:
        return min(self.by_text.get(digest, ()), default=None)

    def nearest(self, unit: np.ndarray) -> str | None:
        """The current memory of largest cosine, if that reaches the threshold."""
        if not self.names or len(unit) != self.matrix.shape[1]:
            return None
        s = self.matrix[: len(self.names)] @ unit
        best = int(np.argmax(s))
        return self.names[best] if self.names[best] and round(float(s[best]), 9) >= self.tau else None

    def change(self, name: str, **values) -> None:
        m = self.rows[name]
        self.rows[name] = replace(m, row=m.row | values)
        self.touched.add(name)

    def close(self, name: str) -> None:
        """The version is no longer the latest from now on."""
        m = self.rows[name]
        self.change(name, is_latest=False, valid_to=self.now)
        if name in self.by_text.get(m.digest, ()):
            self.by_text[m.digest].remove(name)
        if (at := self.place.pop(name, None)) is not None:
            self.names[at], self.matrix[at] = "", -self.matrix[at] * 0

    def insert(self, op: dict, digest: str, unit: np.ndarray, over: str | None, **values) -> dict:
        name = "m_" + hashlib.sha256(f"{op['space']}/{op['seq']}".encode()).hexdigest()[:20]
        row = {"id": name, "space": op["space"], "is_latest": True, "is_forgotten": False, "parent": over, "root": self.rows[over].row["root"] if over else name}
        row |= {"version": self.rows[over].row["version"] + 1 if over else 1, "valid_from": self.now if over else None, "valid_to": None} | values
        if over:
            self.close(over)
        self.put(_Memory(row, digest, unit, op["seq"]))
        self.touched.add(name)
        return row

    def given(self, op: dict, row: dict) -> dict:
        """A row's flags with those that an operation gives."""
        return {k: op[k] if k in op["sets"] else row[k] for k in FLAGS}

    def write(self, op: dict, digest: str, unit: np.ndarray) -> dict:
        if op["dedupe"]:
            if same := self.exact(digest):
                if not set(op["sets"]) & set(FLAGS):
                    return {"action": "unchanged", "id": same, "version": self.rows[same].row["version"]}
                self.change(same, **self.given(op, self.rows[same].row))
                return {"action": "updated", "id": same, "version": self.rows[same].row["version"]}
        fresh = {k: op[k] for k in ("is_static", "is_inference", "metadata", "forget_after")} | {"forget_reason": op["forget_reason"] if op["forget_after"] is not None else None}
        near = self.nearest(unit) if op["dedupe"] else None
        count = self.rows[near].row["source_count"] + 1 if near else 1
        row = self.insert(op, digest, unit, near, source_count=count, **fresh)
        return {"action": "superseded" if near else "created", "id": row["id"], "version": row["version"], "superseded": near}

    def edit(self, op: dict, digest: str | None, unit: np.ndarray | None) -> dict:
        m = self.rows.get(op["target"])
        if m is None:
            return {"action": "missing", "id": op["target"]}
        row = m.row
        if not row["is_latest"]:
            return {"action": "stale", "id": row["id"], "version": row["version"], "latest_id": self.latest.get(row["root"])}
        if op["base"] is not None and op["base"] != row["version"]:
            return {"action": "conflict", "id": row["id"], "version": row["version"], "latest_id": row["id"]}
        if op["kind"] == "patch" or digest == m.digest:
            self.change(row["id"], **self.given(op, row))
            return {"action": "updated", "id": row["id"], "version": row["version"]}
        if unit is None:
            return {"action": "dropped", "id": row["id"]}
        new = self.insert(op, digest, unit, row["id"], source_count=row["source_count"], is_inference=row["is_inference"], **self.given(op, row))
        return {"action": "versioned", "id": new["id"], "version": new["version"], "superseded": row["id"]}


def _unit(v: object) -> np.ndarray | None:
    if v is None:
        return None
    x = np.asarray(v, float)
    size = np.sqrt((x * x).sum())
    return x / size if len(x) and np.isfinite(size) and size > 0 else None


def _rows(pdf: pd.DataFrame) -> list[dict]:
    """Rows with None for what is missing."""
    return [{k: None if not isinstance(v, (list, np.ndarray)) and pd.isna(v) else v for k, v in r.items()} for r in pdf.to_dict("records")]


def gated(ops: DataFrame, allow: Column) -> DataFrame:
    """Operations with secrets taken from texts, metadata and reasons, and the kinds found as ``redacted``."""
    from mnemara.functions import text as tx

    g = ops.withColumn("_g", guards.gate(F.col("text"), F.col("metadata"), allow))
    reason = F.when(allow, F.col("forget_reason")).otherwise(tx.redact_secrets(F.col("forget_reason")))
    return g.withColumn("text", F.col("_g.text")).withColumn("metadata", F.col("_g.metadata")).withColumn("forget_reason", reason).withColumn("redacted", F.col("_g.kinds")).drop("_g")


def decide(state: DataFrame, ops: DataFrame, now: Column, tau: float = 0.95) -> DataFrame:
    """One row an operation (``seq``, ``action``, ...) and, with a null ``seq``, one a memory that is new or changed."""
    digest = F.sha2("text", 256).alias("digest")
    names = [c.strip().split(" ")[0] for c in _ROW.split(",")]
    targets = ops.where("target is not null").select(F.col("target").alias("id")).distinct()
    # Only spaces that are written to matter; what else the state holds isn't shuffled.
    spaces = ops.select("space").distinct()
    state = state.join(spaces, "space", "left_semi").select(*state.columns)
    some = state.where("is_latest").unionByName(state.where("not is_latest").join(targets, "id", "left_semi").select(*state.columns))
    current = some.select(*names, digest, "v")
    asked = ops.select("seq", F.col("space").alias("space"), "kind", "target", "base", digest, "v", "is_static", "is_inference", *FLAGS[1:], "sets", "dedupe", now.cast("timestamp").alias("now"))

    def fold(rows: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(todo):
            return pd.DataFrame(columns=_NAMES)
        space, out = _Space(todo["now"].iloc[0], tau), []
        for r in sorted(_rows(rows), key=lambda r: r["id"]):
            space.put(_Memory({k: r[k] for k in names}, r["digest"], _unit(r["v"])))
        for op in sorted(_rows(todo), key=lambda r: r["seq"]):
            op["sets"] = list(op["sets"]) if op["sets"] is not None else []
            unit = _unit(op["v"])
            if op["kind"] == "write":
                done = space.write(op, op["digest"], unit) if unit is not None and op["digest"] else {"action": "dropped"}
            else:
                done = space.edit(op, op["digest"], unit)
            out.append({"seq": op["seq"], "space": op["space"]} | done)
        for name in sorted(space.touched):
            m = space.rows[name]
            out.append(m.row | {"text_from": m.text_from})
        pdf = pd.DataFrame(out, columns=_NAMES, dtype=object)
        for c in ("seq", "text_from"):
            pdf[c] = pdf[c].astype("Int64")
        for c in ("version", "source_count"):
            pdf[c] = pdf[c].astype("Int32")
        for c in ("forget_after", "valid_from", "valid_to"):
            pdf[c] = pd.to_datetime(pdf[c])
        return pdf

    key = None
    if not ops.where("kind = 'write'").limit(1).count():
        born = ops.select(F.concat(F.lit("m_"), F.substring(F.sha2(F.concat_ws("/", "space", F.col("seq").cast("string")), 256), 1, 20)).alias("target"))
        if not ops.join(born, "target", "left_semi").limit(1).count():  # no edit of what the batch itself writes
            roots = current.select("space", F.col("id").alias("target"), F.col("root").alias("_k"))
            of = asked.join(roots, (asked["space"].eqNullSafe(roots["space"])) & (asked["target"] == roots["target"]), "left").select(asked["*"], F.coalesce("_k", asked["target"], asked["seq"].cast("string")).alias("_k"))
            key = current.withColumn("_k", F.col("root")), of
    elif tau > 1 and not ops.where("not (kind <=> 'write') or target is not null").limit(1).count():
        of = lambda df, own: df.withColumn("_k", F.coalesce("digest", F.col(own).cast("string")))
        key = of(current, "id"), of(asked, "seq")
    if key is None:
        return current.groupBy("space").cogroup(asked.groupBy("space")).applyInPandas(fold, _OUT)
    # Edits alone depend on each other by chain, writes that no cosine decides by text: a space is dealt over parts.
    part = F.pmod(F.xxhash64("_k"), F.lit(max(1, -(-asked.count() // TOGETHER)))).alias("_part")
    left, right = (df.select("*", part).drop("_k").groupBy("space", "_part") for df in key)
    return left.cogroup(right).applyInPandas(fold, _OUT)


def applied(state: DataFrame, ops: DataFrame, decided: DataFrame) -> DataFrame:
    """The state after a batch; ``decided`` is a written table of ``decide``'s rows."""
    rows = decided.where("seq is null").drop("seq", "action", "superseded", "latest_id")
    texts = ops.select(F.col("seq").alias("text_from"), "text", "v")
    new = rows.where("text_from is not null").join(texts, "text_from").select(*state.columns)
    changed = rows.where("text_from is null").join(state.select("id", "text", "v"), "id").select(*state.columns)
    return state.join(rows.select("id"), "id", "left_anti").select(*state.columns).unionByName(changed).unionByName(new)


def provenance(ops: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A grouping document a space with the texts that were written, in order, and its links to the memories (batches are bounded)."""
    did = decided.where("seq is not null").where(F.col("action").isin(*WROTE)).select("seq", "id").join(ops.select("seq", "space", "text"), "seq")
    doc = F.concat(F.lit("d_"), F.substring(F.sha2(F.concat_ws("/", "space", F.col("first").cast("string")), 256), 1, 20))
    each = did.groupBy("space").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"), F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    documents = each.select(doc.alias("id"), "space", F.concat(F.lit("Direct memories ("), F.col("n").cast("string"), F.lit(")")).alias("title"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    links = did.select("space", F.col("id").alias("memory_id")).distinct().join(documents.select("space", F.col("id").alias("document_id")), "space").select("memory_id", "document_id")
    return documents, links
