"""Server-sent events read from bytes: the cases of the original's stream tests."""

import json

import pytest

from mnemara.streaming import chat
from mnemara.streaming.chat import MEMORY_TOOL, Decider


def data(**delta):
    finish = {"finish_reason": delta.pop("finish")} if "finish" in delta else {}
    return f"data: {json.dumps({'choices': [{'delta': delta} | finish]})}\n\n"


def call(arguments, name=None, **where):
    return {"function": {"arguments": arguments} | ({"name": name} if name else {})} | where


def decide(text, size=None, hold=512):
    raw = text if isinstance(text, bytes) else text.encode()
    d = Decider(hold)
    for at in range(0, len(raw), size or len(raw) or 1):
        d = Decider(hold, d.state())  # as between batches
        d.feed(raw[at : at + (size or len(raw))])
        if d.kind:
            return d
    d.end()
    return d


SPLIT = data(tool_calls=[call('{"que', MEMORY_TOOL, index=0, id="a")]) + data(tool_calls=[call('ries":["té"]}', index=0)]) + data(finish="tool_calls")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, None])
def test_fragments_cut_anywhere(size):
    d = decide(SPLIT, size)
    assert d.kind == "memory_tool" and [json.loads(a) for a in d.arguments()] == [{"queries": ["té"]}]


def test_calls_without_index_go_by_id():
    text = data(tool_calls=[call("{1", MEMORY_TOOL, id="x"), call("{2", MEMORY_TOOL, id="y")]) + data(tool_calls=[call("}", id="y"), call("}", id="x")]) + "data: [DONE]\n\n"
    d = decide(text, 11)
    assert d.kind == "memory_tool" and d.arguments() == ["{1}", "{2}"]
    mixed = data(tool_calls=[call("{}", MEMORY_TOOL, id="x"), call("{}", "calculator", index=3)]) + "data: [DONE]\n\n"
    assert decide(mixed).kind == "external_tool"


def test_preamble_comments_and_ends():
    assert decide(data(content="Let me check...") + SPLIT).kind == "memory_tool"
    assert decide(": keep-alive\n\n" + ": again\r\n\r\n" + SPLIT.replace("\n\n", "\r\n\r\n"), 5).kind == "memory_tool"
    assert decide("data: [DONE]\n\n").kind == "answer" and decide("").kind == "answer"
    assert decide("data: {broken\n\ndata: 7\n\ndata: null\n\n" + SPLIT).kind == "memory_tool"
    long = decide(data(content="x" * 300) + data(content="y" * 300) + SPLIT)
    assert long.kind == "answer" and long.kept["held"] == 600
    assert decide(data(content="x" * 512) + SPLIT).kind == "memory_tool" and decide(data(content="x") + SPLIT, hold=0).kind == "answer"
    assert decide(data(content="short", finish="stop")).kind == "answer"
    assert decide(b": " + b"x" * (chat.MAX_HELD_BYTES + 10), 65536).kind == "answer"
    assert decide('data: {"choices":\ndata: [{"delta": {"tool_calls": [{"index": 0, "function": {"name": "other"}}]}}]}\n\n').kind == "external_tool"


class State:
    """A stand-in for the state of a group."""

    def __init__(self):
        self.value, self.exists, self.hasTimedOut, self.wait = None, False, False, None

    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.exists = False

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_silent_streams_are_stalled():
    import pandas as pd

    steps = []

    class Frame:
        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, step, *_):
            steps.append(step)

    chat.classify_stream(Frame(), idle_ms=1000)
    rows = lambda *parts: iter([pd.DataFrame({"seq": range(len(parts)), "bytes": parts})])
    s = State()
    assert not list(steps[0]((5,), rows(SPLIT[:40].encode()), s)) and s.wait == 1000
    s.hasTimedOut = True
    (out,) = steps[0]((5,), iter([]), s)
    assert out.iloc[0].tolist()[:3] == [5, "stalled", 0] and out.iloc[0]["bytes"] == 40 and not s.exists
    s = State()
    (out,) = steps[0]((6,), rows(SPLIT.encode()), s)
    assert out.iloc[0]["kind"] == "memory_tool" and not list(steps[0]((6,), rows(b"more"), s))
    s.hasTimedOut = True
    assert not list(steps[0]((6,), iter([]), s))
