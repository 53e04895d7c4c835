"""Streams of chat: capture of facts, and classification of server-sent events."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemara.functions import text as tx

HOLD_CHARS = 512
MAX_HELD_BYTES = 1 << 20
UNNUMBERED = 1_000_000
MEMORY_TOOL = "memory_search"


def capture(turns: DataFrame) -> DataFrame:
    """Candidate facts of user turns, batch or stream."""
    facts = turns.where("role = 'user'").select("conv_id", "turn", F.posexplode(tx.candidate_facts(F.col("text"))).alias("place", "fact"))
    return facts.select("conv_id", "turn", "place", "fact")


def frames(conversations: DataFrame) -> DataFrame:
    """Chat turns as the frames of a stream: assistant turns are content, user turns fragments of a tool call, others comments.

    Streams of even id name the memory tool, odd ones another; in every third stream user turns are comments too. Every
    stream ends with ``[DONE]``.
    """
    name = F.when(F.col("conv_id") % 2 == 0, MEMORY_TOOL).otherwise("calculator")
    content = F.struct(F.col("text").alias("content"))
    call = F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(name.alias("name"), F.col("text").alias("arguments")).alias("function"))).alias("tool_calls"))

    def data(delta) -> Column:
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices"))))

    calls = (F.col("role") == "user") & (F.col("conv_id") % 3 != 0)
    frame = F.when(F.col("role") == "assistant", data(content)).when(calls, data(call)).otherwise(": keep-alive")
    rows = conversations.select("conv_id", F.col("turn").alias("seq"), frame.alias("frame"))
    last = conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("seq")).withColumn("frame", F.lit("data: [DONE]"))
    return rows.unionByName(last)


def fragments(frames_: DataFrame, most: int = 600) -> DataFrame:
    """Frames as the bytes of a stream, cut anywhere: ``conv_id, seq, bytes`` with ``seq`` in order of arrival."""
    whole = F.encode(F.concat("frame", F.lit("\n\n")), "UTF-8")
    size = (7 + F.pmod(F.xxhash64("conv_id", "seq"), F.lit(most))).cast("int")
    d = frames_.select("conv_id", F.col("seq").alias("_at"), whole.alias("_b"), size.alias("_n"))
    d = d.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("_b") - 1) / F.col("_n")).cast("int"))))
    return d.select("conv_id", (F.col("_at") * 1_000_000 + F.col("_part")).alias("seq"), F.expr("substring(_b, _part * _n + 1, _n)").alias("bytes"))


def classify(frames_: DataFrame, hold: int = HOLD_CHARS) -> DataFrame:
    """Batch form of the decision for each stream of whole frames: ``kind, held, arguments``.

    The first of these in order of ``seq`` decides: content of more than ``hold`` characters before any tool call is an answer;
    the end of the stream is a call of the memory tool if only that was called, another tool's call if one was, else an answer.
    """
    w = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    body = F.regexp_extract("frame", r"(?s)^data: (\{.*)$", 1)
    d = frames_.withColumn("name", F.get_json_object(body, "$.choices[0].delta.tool_calls[0].function.name"))
    d = d.withColumn("part", F.get_json_object(body, "$.choices[0].delta.tool_calls[0].function.arguments"))
    d = d.withColumn("called", F.max(F.col("name").isNotNull()).over(w)).withColumn("content", F.coalesce(F.get_json_object(body, "$.choices[0].delta.content"), F.lit("")))
    d = d.withColumn("total", F.sum(F.when(~F.col("called"), F.length("content")).otherwise(0)).over(w)).withColumn("decides", (F.col("total") > hold) | (F.col("frame") == "data: [DONE]"))
    at = d.groupBy("conv_id").agg(F.min(F.when(F.col("decides"), F.col("seq"))).alias("at"))
    held = d.join(at, "conv_id").where(F.col("seq") <= F.col("at"))
    other = F.max((F.col("name") != MEMORY_TOOL).cast("int"))
    g = held.groupBy("conv_id").agg(
        F.max("total").alias("held"), F.count("name").alias("calls"), other.alias("other"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("seq", "part")))), lambda x: x["part"]), "").alias("arguments"),
    )
    kind = F.when((F.col("held") > hold) | (F.col("calls") == 0), "answer").when(F.col("other") == 1, "external_tool").otherwise("memory_tool")
    return g.select("conv_id", kind.alias("kind"), F.col("held").cast("long").alias("held"), "arguments")


class Decider:
    """Reads a stream's bytes as they come, in fragments cut anywhere, until it is known what the turn is.

    Events end at a blank line; their ``data:`` lines are one JSON text, what can't be parsed and comments are passed over.
    Fragments of a call's arguments are put together by its index, without one by its id. ``kind`` is null while undecided.
    """

    def __init__(self, hold: int = HOLD_CHARS, state: str | None = None) -> None:
        self.hold = hold
        self.kept = json.loads(state) if state else {"tail": "", "calls": {}, "ids": [], "held": 0, "chunks": 0, "bytes": 0}
        self.kind: str | None = None

    def state(self) -> str:
        return json.dumps(self.kept)

    def feed(self, data: bytes) -> None:
        k = self.kept
        k["chunks"], k["bytes"] = k["chunks"] + 1, k["bytes"] + len(data)
        if self.kind:
            return
        *events, tail = re.split(rb"\r?\n\r?\n", bytes.fromhex(k["tail"]) + data)
        k["tail"] = tail.hex()
        for event in events:
            if self._event(event.decode("utf-8", "replace")):
                k["tail"] = ""
                return
        if k["bytes"] > MAX_HELD_BYTES:
            self.kind = "answer"

    def end(self) -> None:
        """The stream is over: the calls that were made decide."""
        if not self.kind:
            names = [c["name"] for c in self.kept["calls"].values()]
            self.kind = "answer" if not names else "external_tool" if any(n != MEMORY_TOOL for n in names) else "memory_tool"

    def arguments(self) -> list[str]:
        """Each call's arguments, by index."""
        return [c["args"] for _, c in sorted(self.kept["calls"].items(), key=lambda x: int(x[0]))]

    def _event(self, event: str) -> bool:
        """Take an event in; True if the turn is decided."""
        payload = "\n".join(line[5:].strip() for line in re.split(r"\r?\n", event) if line.startswith("data:"))
        if payload == "[DONE]":
            self.end()
            return True
        try:
            choice = (json.loads(payload).get("choices") or [{}])[0] if payload else {}
        except (ValueError, AttributeError):
            return False
        delta, k = choice.get("delta") or {}, self.kept
        for call in delta.get("tool_calls") or []:
            index, name = call.get("index"), call.get("id")
            if not isinstance(index, int):
                if name and name not in k["ids"]:
                    k["ids"].append(name)
                index = UNNUMBERED + k["ids"].index(name) if name else 0
            made, f = k["calls"].setdefault(str(index), {"name": "", "args": ""}), call.get("function") or {}
            made["name"] = f.get("name") or made["name"]
            made["args"] += f.get("arguments") or ""
        if not k["calls"] and isinstance(delta.get("content"), str):
            k["held"] += len(delta["content"])
            if delta["content"] and k["held"] > self.hold:
                self.kind = "answer"
                return True
        if choice.get("finish_reason"):
            self.end()
        return self.kind is not None


DECIDED = "conv_id long, kind string, held long, arguments string, chunks long, bytes long"


def classify_stream(parts: DataFrame, hold: int = HOLD_CHARS, idle_ms: int | None = 120_000) -> DataFrame:
    """Decisions of streams of bytes (``conv_id, seq, bytes``) as they fall: what is undecided is kept as state by stream.

    A stream that is silent for ``idle_ms`` before its decision is ``stalled``; one decided passes the rest by. A replay that
    ends when its files do has no clock to wait for: it takes None.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, kept = state.get if state.exists else (0, None)
        decider = Decider(hold, kept)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield _decision(key[0], "stalled", decider)
            return
        rows = sorted((int(s), bytes(b)) for pdf in pdfs for s, b in zip(pdf["seq"], pdf["bytes"], strict=True))
        if not done:
            for _, data in rows:
                decider.feed(data)
                if decider.kind:
                    break
            if decider.kind:
                yield _decision(key[0], decider.kind, decider)
        state.update((int(bool(done or decider.kind)), None if done or decider.kind else decider.state()))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return parts.groupBy("conv_id").applyInPandasWithState(step, DECIDED, "done long, kept string", "append", timeout)


def _decision(stream: int, kind: str, d: Decider) -> pd.DataFrame:
    return pd.DataFrame([(stream, kind, d.kept["held"], "".join(d.arguments()), d.kept["chunks"], d.kept["bytes"])], columns=[c.split()[0] for c in DECIDED.split(", ")])


def stream_sizes(parts: DataFrame) -> DataFrame:
    """Chunks and bytes that each stream passed on."""
    return parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("bytes")).alias("bytes"))
