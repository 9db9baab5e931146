"""Model events as chunks for ``restore_stream``: each text or argument stream of a response gets a key of its own, so nothing is
stitched across blocks, choices, tools or items; the event that closes one is its final chunk.

``events`` has stream_id, n (the order of events in a stream) and event (JSON). The key is put into the chunks' stream_id, as
``stream_id/kind/...``; kinds that carry serialized JSON end in ``json`` and are restored with mode ``json``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .restore import CHUNKS, restore_chunks, restore_stream, with_rocksdb

STYLES = ("blocks", "chat", "items")


def _get(path: str):
    return F.get_json_object("event", path)


#: (stream_id, n, place, what, chunk, final) of the events, each by itself. A final row without what closes all that is open at its place.
KEYS = {"blocks": "block-{what}/{place}", "chat": "{place}/{what}", "items": "{what}/{place}"}
JSON_KEYS = "/(?:block|tool|arguments)-json/"


def _blocks(events: DataFrame) -> DataFrame:
    """content_block_delta and content_block_stop, by block index."""
    kind, delta = _get("$.type"), _get("$.delta.type")
    some = events.withColumn("kind", kind).where(F.col("kind").isin("content_block_delta", "content_block_stop"))
    text = F.when(delta == "text_delta", _get("$.delta.text")).when(delta == "input_json_delta", _get("$.delta.partial_json"))
    what = F.when(text.isNull(), None).when(delta == "text_delta", "text").otherwise("json")
    rows = some.select("stream_id", "n", _get("$.index").alias("place"), what.alias("what"), F.coalesce(text, F.lit("")).alias("chunk"), (F.col("kind") == "content_block_stop").alias("final"))
    return rows.where("final or what is not null")


def _chat(events: DataFrame) -> DataFrame:
    """Content, refusals and tool arguments, by choice and tool; finish_reason closes all streams of a choice."""
    call = "struct<index:int,function:struct<arguments:string>>"
    delta = f"struct<content:string,refusal:string,tool_calls:array<{call}>>"
    choice = F.explode(F.from_json(_get("$.choices"), f"array<struct<index:int,finish_reason:string,delta:{delta}>>"))
    each = events.select("stream_id", "n", choice.alias("c"))
    row = lambda what, chunk, final: F.struct(what.alias("what"), chunk.alias("chunk"), F.lit(final).alias("final"))
    tools = F.transform(F.coalesce("c.delta.tool_calls", F.array().cast(f"array<{call}>")), lambda t: row(F.concat(F.lit("tool-json/"), t["index"].cast("string")), t["function"]["arguments"], False))
    plain = [row(F.lit(k), F.col(f"c.delta.{k}"), False) for k in ("content", "refusal")]
    end = F.when(F.col("c.finish_reason").isNotNull(), F.array(row(F.lit(None).cast("string"), F.lit(""), True))).otherwise(F.array().cast("array<struct<what:string,chunk:string,final:boolean>>"))
    parts = each.select("stream_id", "n", F.col("c.index").cast("string").alias("place"), F.explode(F.concat(F.array(*plain), tools, end)).alias("p"))
    return parts.where("p.chunk is not null").select("stream_id", "n", "place", "p.*")


def _items(events: DataFrame) -> DataFrame:
    """response.*.delta and .done events, by item and content index."""
    kind = _get("$.type")
    what = F.regexp_extract(kind, r"^response\.(output_text|refusal|function_call_arguments|custom_tool_call_input|reasoning_summary_text)\.(delta|done)$", 1)
    some = events.withColumns({"kind": kind, "what": what}).where("what <> ''")
    label = F.when(F.col("what") == "function_call_arguments", "arguments-json").otherwise(F.col("what"))
    place = F.concat_ws("/", F.coalesce(_get("$.item_id"), F.lit("")), F.coalesce(_get("$.content_index"), _get("$.summary_index"), F.lit("0")))
    final = F.col("kind").endswith(".done")
    return some.select("stream_id", "n", place.alias("place"), label.alias("what"), F.when(final, "").otherwise(F.coalesce(_get("$.delta"), F.lit(""))).alias("chunk"), final.alias("final"))


def rows(events: DataFrame, style: str) -> DataFrame:
    if style not in STYLES:
        raise ValueError(f"style is one of {STYLES}")
    return {"blocks": _blocks, "chat": _chat, "items": _items}[style](events)


def chunks(events: DataFrame, style: str) -> DataFrame:
    """(stream_id, block, seq, chunk, final) of a batch of events; ``stream_id`` is the key described above, ``block`` is 0."""
    all_ = rows(events, style)
    known = all_.where("what is not null").select("stream_id", "place", "what").distinct()
    closing = all_.where("what is null").drop("what").groupBy("stream_id", "place").agg(F.min("n").alias("n"), F.first("chunk").alias("chunk"), F.first("final").alias("final"))
    closed = closing.join(known, ["stream_id", "place"]).select(*all_.columns)
    # What comes after its place was closed belongs to nothing.
    said = all_.where("what is not null").join(closing.select("stream_id", "place", F.col("n").alias("_end")), ["stream_id", "place"], "left").where("_end is null or n <= _end").select(*all_.columns)
    named = said.unionByName(closed).withColumn("key", F.concat_ws("/", "stream_id", _key(style)))
    seq = F.row_number().over(Window.partitionBy("key").orderBy("n", "final")) - 1
    return named.select(F.col("key").alias("stream_id"), F.lit(0).alias("block"), seq.cast("long").alias("seq"), "chunk", "final")


def _key(style: str):
    parts = KEYS[style].replace("{what}", "\0what\0").replace("{place}", "\0place\0").split("\0")
    return F.concat(*[F.col(p) if p in ("what", "place") else F.lit(p) for p in parts if p])


class Numbering(StatefulProcessor):
    """Numbers the chunks of each key of a stream in the order in which its events come, and closes keys by their stop events."""

    def __init__(self, style: str, idle: int | None):
        self.key, self.ttl = KEYS[style], idle and 1000 * idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Next number by place and what; -1 for a closed one. Entries that aren't touched for the time to live go away.
        self.open = handle.getMapState("open", "place string, what string", "next long", *([self.ttl] if self.ttl else []))

    def handleInputRows(self, key, batches, timerValues) -> Iterator[pd.DataFrame]:
        here = {tuple(k): v[0] for k, v in self.open.iterator()}
        before, out = dict(here), []
        news = pd.concat(list(batches)).sort_values(["n", "final"], kind="stable")
        for place, what, chunk, final in zip(news["place"], news["what"], news["chunk"], news["final"], strict=True):
            places = [k for k in here if k[0] == place] if what is None else [(place, what)]
            for at in places:
                n = here.get(at, 0)
                if n < 0:
                    continue
                out.append((f"{key[0]}/{self.key.format(place=at[0], what=at[1])}", 0, n, chunk, bool(final)))
                here[at] = -1 if final else n + 1
        for at, n in here.items():
            if before.get(at) != n:
                self.open.updateValue(at, (n,))
        yield pd.DataFrame(out, columns=["stream_id", "block", "seq", "chunk", "final"])

    def close(self) -> None:
        pass


def chunks_stream(events: DataFrame, style: str, idle: int | None = 3600) -> DataFrame:
    """As ``chunks``, for a stream of events whose files or topics keep each stream's order between micro-batches; ``idle`` as in ``restore_stream``."""
    with_rocksdb(events.sparkSession)
    return rows(events, style).groupBy("stream_id").transformWithStateInPandas(Numbering(style, idle), CHUNKS, "append", "processingTime" if idle else "none")


def restored_stream(events: DataFrame, vault: DataFrame, style: str, vault_of: str = "", idle: int | None = 3600) -> DataFrame:
    """Events to restored chunks, in one query: numbered by key, then restored in order, keys of serialized JSON by the JSON lexer."""
    return restore_stream(chunks_stream(events, style, idle), vault, "text", vault_of, idle=idle, json_keys=JSON_KEYS)


def restored(events: DataFrame, vault: DataFrame, style: str, vault_of: str = "") -> DataFrame:
    """(key, text) of each stream of a batch of events, surrogates restored; JSON streams by the JSON lexer."""
    all_ = chunks(events, style)
    is_json = F.col("stream_id").rlike(JSON_KEYS)
    out = restore_chunks(all_.where(~is_json), vault, "text", vault_of).unionByName(restore_chunks(all_.where(is_json), vault, "json", vault_of))
    return out.groupBy(F.col("stream_id").alias("key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
