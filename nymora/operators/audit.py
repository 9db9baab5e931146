"""Leak audit: known originals that occur in a text, and personal data that no vault knows."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.hits import Cover
from ..functions.scan import scan
from .detect import checked, entities
from .restore import key_of
from .spans import not_within
from .windows import nominated

FINDING = "struct<kind:string,type:string,value:string,start:int,end:int,detector:string,confidence:double>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detector", pa.string()), ("confidence", pa.float64())]))
PREFIX = 32


class Literals:
    """Known values by prefix of at most PREFIX characters; a prefix only nominates, whole values decide."""

    def __init__(self, values: Iterable[str]):
        self.by: dict[str, list[str]] = {}
        self.sizes: dict[str, list[int]] = {}
        for v in dict.fromkeys(values):
            if v:
                self.by.setdefault(v[:PREFIX], []).append(v)
        for p in self.by:
            self.sizes.setdefault(p[0], []).append(len(p))
        self.sizes = {c: sorted(set(n)) for c, n in self.sizes.items()}
        self.whole = {p: (sorted({len(v) for v in vs}), set(vs)) for p, vs in self.by.items()}

    def occurrences(self, text: str):
        """(start, value) of all, overlapping ones too."""
        for at, c in enumerate(text):
            for n in self.sizes.get(c, ()):
                lengths, values = self.whole.get(text[at : at + n], ((), ()))
                for size in lengths:
                    if text[at : at + size] in values:
                        yield at, text[at : at + size]


class Known:
    """A vault's mappings for the audit of texts: rows of (type, original, surrogate), in order."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.by_original: dict[str, list[tuple[int, str]]] = {}
        for i, (kind, original, _) in enumerate(rows):
            self.by_original.setdefault(original, []).append((i, kind))
        self.originals, self.surrogates = Literals(r[1] for r in rows), Literals(r[2] for r in rows)
        self.values = {r[1] for r in rows} | {r[2] for r in rows}

    def leaks(self, text: str) -> list[dict]:
        free: dict[str, int] = {}
        found = []
        for start, value in self.originals.occurrences(text):
            if start >= free.get(value, 0):
                free[value] = start + len(value)
                found += [(start, order, kind, value) for order, kind in self.by_original[value]]
        return [_finding("leaked_original", kind, value, start, "vault", 1.0) for start, _, kind, value in sorted(found)]

    def news(self, text: str, detectors: list[str]) -> list[dict]:
        hits = [h for h in scan(text, detectors, resolved=False) if text[h.start : h.end] not in self.values]
        if not hits:
            return []
        known = Cover((s, s + len(v)) for lit in (self.originals, self.surrogates) for s, v in lit.occurrences(text))
        return [_finding("new_pii", h.type, text[h.start : h.end], h.start, h.detector, h.confidence) for h in sorted(hits, key=lambda h: h.start) if not known.holds(h.start, h.end)]


def _finding(kind: str, type_: str, value: str, start: int, detector: str, confidence: float) -> dict:
    return {"kind": kind, "type": type_, "value": value, "start": start, "end": start + len(value), "detector": detector, "confidence": confidence}


def findings(df: DataFrame, vault: DataFrame, text: str = "text", vault_id: str | None = None, detectors: Iterable[str] | None = None, leaks: bool = True, broadcast_rows: int = 200_000) -> DataFrame:
    """``df`` with ``findings`` in text order. ``detectors``: None for the default ones, [] for no new-data check.

    Vaults of at most ``broadcast_rows`` mappings in all (counted) are broadcast; otherwise each row is joined with its own vault's.
    """
    detectors = checked(fixed.DEFAULT_DETECTORS if detectors is None else detectors)
    key = key_of(vault_id)
    rows = vault.select("vault_id", "ord", "type", "original", "surrogate")

    def judged(t: str | None, known: Known) -> list[dict]:
        if not t:
            return []
        return sorted([*(known.leaks(t) if leaks else []), *(known.news(t, detectors) if detectors else [])], key=lambda f: f["start"])

    if rows.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by: dict[str, list] = {}
        for v, _, kind, o, s in sorted(map(tuple, rows.collect())):
            by.setdefault(v, []).append((kind, o, s))
        shared, made = df.sparkSession.sparkContext.broadcast(by), {}

        @F.arrow_udf(f"array<{FINDING}>")
        def look(texts: pa.Array, vaults: pa.Array) -> pa.Array:
            out = []
            for t, v in zip(texts.to_pylist(), vaults.to_pylist(), strict=True):
                if v not in made:
                    made[v] = Known(shared.value.get(v, []))
                out.append(judged(t, made[v]))
            return pa.array(out, ARROW)

        return df.withColumn("findings", look(F.col(text), key))
    if rows.groupBy("vault_id").count().agg(F.max("count")).head()[0] > broadcast_rows:
        raise ValueError(f"a vault has more than {broadcast_rows} mappings; use findings_joined")
    lists = rows.groupBy("vault_id").agg(F.sort_array(F.collect_list(F.struct("ord", "type", "original", "surrogate"))).alias("_known"))

    @F.arrow_udf(f"array<{FINDING}>")
    def look_own(texts: pa.Array, own: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), own.to_pylist(), strict=True)
        return pa.array([judged(t, Known([(r["type"], r["original"], r["surrogate"]) for r in k or []])) for t, k in pairs], ARROW)

    joined = df.withColumn("_key", key).join(lists.withColumnRenamed("vault_id", "_key"), "_key", "left")
    return joined.withColumn("findings", look_own(F.col(text), F.col("_known"))).drop("_known", "_key")


def findings_joined(df: DataFrame, vault: DataFrame, key: str, text: str = "text", detectors: Iterable[str] | None = None) -> DataFrame:
    """(key, kind, type, value, start, end) for one vault of any size, by joins alone, as ``findings`` has them; ``key`` tells the rows apart."""
    leaks = leaked_joined(df, vault, key, text)
    out = apart(leaks, key).select(key, F.lit("leaked_original").alias("kind"), "type", "value", "start", "end")
    detectors = checked(fixed.DEFAULT_DETECTORS if detectors is None else detectors)
    if not detectors:
        return out
    marks = leaked_joined(df, vault.withColumn("original", F.col("surrogate")), key, text)
    known = leaks.select(key, "start", "end").unionByName(marks.select(key, "start", "end")).distinct()
    hits = df.select(key, F.explode(entities(text, None, detectors, resolved=False)).alias("e")).select(key, "e.type", "e.value", "e.start", "e.end")
    values = vault.select(F.col("original").alias("value")).union(vault.select("surrogate")).distinct()
    new = not_within(hits.join(values, "value", "left_anti"), known, [key])
    return out.unionByName(new.select(key, F.lit("new_pii").alias("kind"), "type", "value", "start", "end"))


def _apart(starts: pa.Array, size: pa.Array) -> pa.Array:
    out = []
    for own, n in zip(starts.to_pylist(), size.to_pylist(), strict=True):
        kept: list[int] = []
        for s in own:
            if not kept or s >= kept[-1] + n:
                kept.append(s)
        out.append(kept)
    return pa.array(out, pa.list_(pa.int32()))


def apart(found: DataFrame, key: str) -> DataFrame:
    """(key, type, value, start, end): of overlapping occurrences of a value in a row the leftmost, then the next that doesn't overlap it, and so on."""
    runs = found.groupBy(key, "type", "value").agg(F.sort_array(F.collect_list("start")).alias("_s"))
    kept = runs.withColumn("start", F.explode(F.arrow_udf(_apart, "array<int>")("_s", F.length("value"))))
    return kept.select(key, "type", "value", "start", (F.col("start") + F.length("value")).alias("end"))


#: Lengths of the prefixes by which long vaults are joined; a value goes by the longest that it reaches, or by its own length.
TIERS = (4, 7, 12, PREFIX)


def leaked_joined(df: DataFrame, vault: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, type, value, start, end) of known originals in texts, for one vault of any size; ``key`` tells the rows apart.

    Windows of the texts that pass a bit map of the originals' prefixes are joined with these by equality; only rows with a nominated value meet their text
    again, where whole values are compared. Overlapping occurrences of a value are all given.
    """
    tier = F.least(F.length("original"), F.array_max(F.filter(F.array(*map(F.lit, (0, 1, 2, 3, *TIERS))), lambda n: n <= F.length("original"))))
    values = vault.where(F.length("original") > 0).select("type", "original", tier.alias("_n")).withColumn("_p", F.expr("substring(original, 1, _n)"))
    windows = nominated(df, text, [key], values, "_p").select(key, F.col("at").alias("_at"), F.col("piece").alias("_p"))
    hit = windows.join(values, "_p").select(key, "type", "original", F.col("_at").alias("start"))
    whole = hit.join(df.select(key, F.col(text).alias("_t")), key).where(F.substring("_t", F.col("start") + 1, F.length("original")) == F.col("original"))
    return whole.select(key, "type", F.col("original").alias("value"), "start", (F.col("start") + F.length("original")).alias("end"))

