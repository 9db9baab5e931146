"""Streams whose state goes away, and events numbered as they come."""

import json
import time

import pytest

from nymora.sources import vault as vaults
from nymora.streaming import events
from nymora.streaming import restore as streams

LONG = "stream_id string, block int, seq long, chunk string, final boolean"


def vault_of(spark):
    return spark.createDataFrame([("", 0, "EMAIL", "bob@x.org", "⟨EMAIL_1⟩", "e"), ("", 1, "EMAIL", "ann@x.org", "⟨EMAIL_12⟩", "e")], vaults.SCHEMA)


def added(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def until(holds, seconds=90):
    """``processAllAvailable`` doesn't return while timers keep a query running."""
    end = time.time() + seconds
    while not holds():
        assert time.time() < end
        time.sleep(0.5)


def state_rows(query):
    return sum(x["numRowsTotal"] for x in query.lastProgress["stateOperators"]) if query.lastProgress else None


def test_state_is_flushed_by_timers_and_expires(spark, tmp_path):
    folder = str(tmp_path / "in")
    first = [("a", 0, 1, "IL_1⟩ and ⟨EMA", False), ("a", 0, 0, "to ⟨EMA", False), ("b", 0, 0, "⟨EMAIL_1", False), ("b", 0, 2, "late", False), ("c", 0, 0, "⟨EMAIL_12⟩!", True), ("c", 0, 0, "again", True)]
    added(spark, folder, first, LONG)
    chunks = spark.readStream.schema(LONG).json(folder)
    out = streams.restore_stream(chunks, vault_of(spark), idle=15, finished=4)
    query = out.writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    shown = lambda: {(r.stream_id, r.seq): r.text for r in spark.table("flushed").collect()}
    try:
        until(lambda: len(shown()) == 4)
        assert shown() == {("a", 0): "to ", ("a", 1): "bob@x.org and ", ("b", 0): "", ("c", 0): "ann@x.org!"}
        added(spark, folder, [("a", 0, 2, "IL_12⟩", True), ("c", 0, 1, "ignored", True)], LONG)
        until(lambda: ("a", 2) in shown())
        until(lambda: ("b", 1) in shown())  # the timer
        got = shown()
        assert got["a", 2] == "ann@x.org" and got["b", 1] == "⟨EMAIL_1late" and len(got) == 6
        until(lambda: state_rows(query) == 0)
    finally:
        query.stop()


def events_of(style):
    """(stream_id, n, event): two streams of each style, interleaved, with text and serialized JSON."""
    quoted = json.dumps({"to": "⟨EMAIL_12⟩", "⟨EMAIL_1⟩": 1}, ensure_ascii=True)
    text = "to ⟨EMAIL_1⟩ and ⟨EMAIL_12⟩"
    cut = lambda t: [t[i : i + 4] for i in range(0, len(t), 4)]
    if style == "blocks":
        parts = [{"type": "message_start"}, *({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": c}} for c in cut(text)), *({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": c}} for c in cut(quoted)),
                 {"type": "content_block_stop", "index": 0}, {"type": "content_block_stop", "index": 1}, {"type": "content_block_stop", "index": 7}]
    elif style == "chat":
        parts = [*({"choices": [{"index": 0, "delta": {"content": c}}, {"index": 1, "delta": {"refusal": c}}]} for c in cut(text)), *({"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 2, "function": {"arguments": c}}]}}]} for c in cut(quoted)),
                 {"choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}, {"index": 1, "delta": {}, "finish_reason": "stop"}]}]
    else:
        parts = [*({"type": "response.output_text.delta", "item_id": "i", "content_index": 0, "delta": c} for c in cut(text)), {"type": "response.output_text.done", "item_id": "i", "content_index": 0},
                 *({"type": "response.function_call_arguments.delta", "item_id": "j", "delta": c} for c in cut(quoted)), {"type": "response.function_call_arguments.done", "item_id": "j"}]
    return [(s, n, json.dumps(e)) for n, e in enumerate(parts) for s in ("s1", "s2")]


@pytest.mark.parametrize("style", events.STYLES)
def test_event_streams_give_what_batches_give(spark, tmp_path, style):
    schema, folder, vault = "stream_id string, n long, event string", str(tmp_path / "in"), vault_of(spark)
    every = events_of(style)
    half = len(every) // 2
    for rows in (every[:half], every[half:]):
        added(spark, folder, rows, schema)
    whole = {r.key: r.text for r in events.restored(spark.createDataFrame(every, schema), vault, style).collect()}
    assert len(whole) >= 4 and all("ann@x.org" in t and "⟨EMAIL_12⟩" not in t for t in whole.values())
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(folder)
    query = events.restored_stream(source, vault, style, idle=None).writeStream.format("memory").queryName(f"events_{style}").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {}
    for r in spark.table(f"events_{style}").orderBy("stream_id", "seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == whole


class Counted:
    """A state variable that counts its calls, of which each is a round trip to the JVM."""

    def __init__(self, calls):
        self.value, self.calls = None, calls

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            return self.value if name == "get" else self.value is not None

        return call


def test_a_whole_stream_takes_two_state_calls():
    import pandas as pd

    class Handle:
        calls = []
        getValueState = getMapState = lambda self, *_: Counted(self.calls)

    class Shared:
        value = [("⟨EMAIL_1⟩", "bob@x.org")]

    done = streams.Restoring(Shared(), "text", None, 60, None)
    done.init(Handle())
    rows = pd.DataFrame([(1, "IL_1⟩", True), (0, "to ⟨EMA", False)], columns=["seq", "chunk", "final"])
    (out,) = done.handleInputRows(("a", 0), iter([rows]), None)
    assert "".join(out["text"]) == "to bob@x.org" and Handle.calls == ["get", "update"]
    assert not list(done.handleInputRows(("a", 0), iter([rows]), None)) and Handle.calls == ["get", "update", "get"]
