"""Restoration of streams: chunks keyed by stream and block, in sequence, holding back only what may still be a surrogate.

Input columns: stream_id string, block int, seq long (from 0), chunk string, final boolean. Output: one row per chunk in order, with what
it releases; the final chunk of a key releases the rest. Chunks that come before their turn wait in a map state, by number. The vault is fixed when the query starts.

State goes away: a key without news for ``idle`` seconds is flushed by a timer, which releases what was held back and what waits, in order, as one row more; what
comes later for a finished key is ignored for ``finished`` seconds, for which only a mark is kept, with a time to live.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.lookup import JSONStream, Lookup, TextStream

CHUNKS = "stream_id string, block int, seq long, chunk string, final boolean"
OUTPUT = "stream_id string, block int, seq long, text string"
#: The next number of a key that is finished.
FINISHED = -1
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _shared(chunks: DataFrame, vault: DataFrame, vault_of: str, max_mappings: int):
    """The vault's pairs, broadcast after a count."""
    pairs = vault.where(F.col("vault_id") == vault_of).select("surrogate", "original")
    if pairs.limit(max_mappings + 1).count() > max_mappings:
        raise ValueError(f"more than {max_mappings} mappings; restore streams by smaller vaults")
    return chunks.sparkSession.sparkContext.broadcast([tuple(r) for r in pairs.collect()])


def with_rocksdb(spark: SparkSession) -> None:
    """State with timers and lists needs this provider; a session that chose another one is left alone."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


class Late:
    """A broadcast that is looked up when it is used: Spark also loads a processor in a process of the driver that has no broadcasts."""

    def __init__(self, found):
        self.found = found

    def __reduce__(self):
        return Late, (self.found if isinstance(self.found, tuple) else self.found.__reduce__(),)

    @property
    def value(self):
        if isinstance(self.found, tuple):
            make, arguments = self.found
            self.found = make(*arguments)
        return self.found.value


class Restoring(StatefulProcessor):
    """Chunks of one key in order."""

    def __init__(self, shared, mode: str, idle: int | None, finished: int, json_keys: str | None):
        self.shared, self.kind, self.idle, self.finished = Late(shared), JSONStream if mode == "json" else TextStream, idle and 1000 * idle, 1000 * finished
        self.lookup: Lookup | None = None
        self.json_keys = json_keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next long, held string, timer long, waiting int")
        self.waiting = handle.getMapState("waiting", "seq long", "chunk string, final boolean")
        # Without times to live, a finished key's mark is its head itself, with the next number FINISHED: each call of a state is a round trip.
        self.done = handle.getValueState("done", "at long", self.finished) if self.idle else None

    def _fed(self, key: tuple, now: int, head: tuple | None, ready: list[tuple[int, str, bool]], flush: bool) -> Iterator[pd.DataFrame]:
        if self.lookup is None:
            self.lookup = Lookup(self.shared.value)
        next_, held, timer, n = head or (0, "", -1, 0)
        # The state is read and written once a call, not once a chunk.
        kept = {seq: value for (seq,), value in self.waiting.iterator()} if n else {}
        here = dict(kept)
        for seq, chunk, final in ready:
            if seq >= next_:
                here.setdefault(seq, (chunk, final))
        kind = JSONStream if self.json_keys and re.search(self.json_keys, key[0] or "") else self.kind
        stream = kind.load(self.lookup, held) if held else kind(self.lookup)
        out, ended = [], False
        while not ended and next_ in here:
            chunk, ended = here.pop(next_)
            out.append((*key, next_, stream.feed(chunk, ended)))
            next_ += 1
        if flush and not ended:
            out.append((*key, next_, "".join([*(stream.feed(here[seq][0]) for seq in sorted(here)), stream.feed("", True)])))
            ended = True
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if ended:
            if kept:
                self.waiting.clear()
            if self.done is None:
                self.head.update((FINISHED, "", -1, 0))
            else:
                if head:
                    self.head.clear()
                self.done.update((now,))
        else:
            for seq in kept.keys() - here.keys():
                self.waiting.removeKey((seq,))
            for seq in here.keys() - kept.keys():
                self.waiting.updateValue((seq,), here[seq])
            if self.idle:
                self.handle.registerTimer(now + self.idle)
            self.head.update((next_, stream.state(), now + self.idle if self.idle else -1, len(here)))
        yield pd.DataFrame(out, columns=["stream_id", "block", "seq", "text"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ready = [(int(s), c or "", bool(f)) for batch in rows for s, c, f in zip(batch["seq"], batch["chunk"], batch["final"], strict=True)]
        head = self.head.get()
        if head and head[0] != FINISHED or not head and (self.done is None or not self.done.exists()):
            yield from self._fed(key, timerValues.getCurrentProcessingTimeInMs() if self.idle else 0, head, ready, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head = self.head.get()
        if head and head[2] == expiredTimerInfo.getExpiryTimeInMs():
            next_, held, _, n = head
            yield from self._fed(key, timerValues.getCurrentProcessingTimeInMs(), (next_, held, -1, n), [], True)

    def close(self) -> None:
        pass


def restore_stream(chunks: DataFrame, vault: DataFrame, mode: str = "text", vault_of: str = "", max_mappings: int = 1_000_000, idle: int | None = 3600, finished: int = 3600, json_keys: str | None = None) -> DataFrame:
    """``chunks`` restored by one vault (exact matching); ``mode`` json decodes string values of serialized JSON. Times in seconds.

    Streams whose stream_id matches ``json_keys`` are JSON whatever the mode. Timers keep a query running; ``idle`` None is for one that ends with its input (``availableNow``): there nothing is flushed and marks stay.
    """
    with_rocksdb(chunks.sparkSession)
    processor = Restoring(_shared(chunks, vault, vault_of, max_mappings), mode, idle, finished, json_keys)
    return chunks.groupBy("stream_id", "block").transformWithStateInPandas(processor, OUTPUT, "append", "processingTime" if idle else "none")


def restore_chunks(chunks: DataFrame, vault: DataFrame, mode: str = "text", vault_of: str = "", max_mappings: int = 1_000_000) -> DataFrame:
    """The batch counterpart: each key's chunks sorted by seq and fed in turn."""
    shared, made = _shared(chunks, vault, vault_of, max_mappings), []
    kind = JSONStream if mode == "json" else TextStream

    def feed(frame: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Lookup(shared.value))
        stream, frame = kind(made[0]), frame.sort_values("seq")
        frame["text"] = [stream.feed(c or "", bool(f)) for c, f in zip(frame["chunk"], frame["final"], strict=True)]
        return frame[["stream_id", "block", "seq", "text"]]

    return chunks.groupBy("stream_id", "block").applyInPandas(feed, OUTPUT)
