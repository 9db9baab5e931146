"""Surrogates in text back to originals: exact, tolerant, or within JSON.

Small vaults (counted, at most ``broadcast_rows`` mappings) are broadcast as lookups; larger ones are joined. Both give the same results. A null vault_id names
the default vault, ''.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StringType

from ..functions.lookup import Folded, Lookup, escaped, json_values, restore as restore_text, restore_json, spelled
from .tables import stored
from .windows import nominator

MODES = ("text", "json")


def _apply(texts, lookups, tolerant: bool, mode: str) -> pa.Array:
    out = []
    for t, lookup in zip(texts, lookups, strict=True):
        out.append(t if t is None or lookup is None else restore_json(t, lookup) if mode == "json" else restore_text(t, lookup, tolerant))
    return pa.array(out, pa.string())


def key_of(vault_id: str | None) -> Column:
    """The vault of a row; without one, or with null, the default vault."""
    return F.coalesce(F.col(vault_id).cast("string"), F.lit("")) if vault_id else F.lit("")


@F.arrow_udf(StringType())
def spelling_of(surrogates: pa.Array) -> pa.Array:
    return pa.array([spelled(s) for s in surrogates.to_pylist()], pa.string())


#: Lookups that a worker keeps of the vaults it met last: with a vault a conversation there are as many vaults as mappings.
KEPT = 1024


def _broadcast(pairs: DataFrame):
    """A function that gives a vault's lookup, made by each worker; ``pairs`` were counted to be few."""
    by: dict[str, list] = {}
    for v, s, o in pairs.collect():
        by.setdefault(v or "", []).append((s, o))
    shared, made = pairs.sparkSession.sparkContext.broadcast(by), {}

    def lookup(v: str | None) -> Lookup | None:
        own = made.pop(v, None)
        if own is None and v in shared.value:
            own = Lookup(shared.value[v])
        if own is not None:
            made[v] = own  # at the end, as the latest
            if len(made) > KEPT:
                del made[next(iter(made))]
        return own

    return lookup


def unfaithful(df: DataFrame, vault: DataFrame, text: str, source: str, vault_id: str, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows whose ``text`` isn't restored to ``source``, be it exactly or tolerantly."""
    pairs = vault.select("vault_id", "surrogate", "original")
    if pairs.limit(broadcast_rows + 1).count() > broadcast_rows:
        bad = [restore(df, vault, text, vault_id, tolerant, broadcast_rows=broadcast_rows).where(~F.col("restored").eqNullSafe(F.col(source))) for tolerant in (False, True)]
        return bad[0].unionByName(bad[1])
    lookup = _broadcast(pairs)

    @F.arrow_udf("boolean")
    def same(texts: pa.Array, sources: pa.Array, vaults: pa.Array) -> pa.Array:
        out = []
        for t, s, v in zip(texts.to_pylist(), sources.to_pylist(), vaults.to_pylist(), strict=True):
            own = lookup(v) if t is not None else None
            out.append(t == s if own is None else restore_text(t, own, False) == s and restore_text(t, own, True) == s)
        return pa.array(out, pa.bool_())

    return df.where(~same(F.col(text), F.col(source), F.col(vault_id)))


def restore(df: DataFrame, vault: DataFrame, text: str = "masked", vault_id: str | None = None, tolerant: bool = True, mode: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """``df`` with ``restored``."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    key = key_of(vault_id)
    pairs = vault.select("vault_id", "surrogate", "original")
    if pairs.limit(broadcast_rows + 1).count() <= broadcast_rows:
        lookup = _broadcast(pairs)

        @F.arrow_udf("string")
        def back(texts: pa.Array, vaults: pa.Array) -> pa.Array:
            return _apply(texts.to_pylist(), map(lookup, vaults.to_pylist()), tolerant, mode)

        return df.withColumn("restored", back(F.col(text), key))
    return restore_joined(df, vault, text, vault_id, tolerant, mode)


HITS = "array<struct<start:int,end:int,loose:boolean,piece:string>>"


def restore_joined(df: DataFrame, vault: DataFrame, text: str = "masked", vault_id: str | None = None, tolerant: bool = False, mode: str = "text") -> DataFrame:
    """``restore`` for vaults of any size and surrogates of any kind, by equality joins alone.

    Windows of the texts (tolerant: of the folded texts too, at word edges; JSON: of decoded string values) that pass a bit map of the surrogates are joined with
    the vault. Of a row's matches the scan keeps, from left to right, the exact one before a tolerant one and then the longest, and splices the
    originals in. Surrogates that stand for several originals in their folded spelling aren't restored tolerantly.
    """
    tolerant = tolerant and mode == "text"
    rows = stored(df.withColumns({"_key": key_of(vault_id), "_n": F.monotonically_increasing_id()}))
    pairs = vault.select(F.coalesce("vault_id", F.lit("")).alias("_key"), F.col("surrogate").alias("piece"), "original").where("piece <> ''")
    exact = pairs.withColumn("loose", F.lit(False))
    spark = df.sparkSession
    found = nominator(exact, "piece")
    folded, table = None, exact
    if tolerant:
        loose = pairs.withColumn("piece", spelling_of("piece")).where("piece <> ''").groupBy("_key", "piece").agg(F.min("original").alias("original"), F.max("original").alias("_other"))
        loose = stored(loose.where("original = _other").select("_key", "piece", "original", F.lit(True).alias("loose")))
        folded, table = (nominator(loose, "piece"), loose.where(F.contains("piece", F.lit(" "))).limit(1).count() > 0), exact.unionByName(loose)
    shared = spark.sparkContext.broadcast((found, folded))

    @F.arrow_udf(HITS)
    def look(texts: pa.Array) -> pa.Array:
        exact_, loose_ = shared.value
        texts = [t or "" for t in texts.to_pylist()]
        hits = [[] for _ in texts]
        values = [(i, v, places) for i, t in enumerate(texts) for v, places in (json_values(t) if mode == "json" else [(t, None)])]
        for k, a, b in exact_.find_all([v for _, v, _ in values]):
            i, v, places = values[k]
            hits[i].append({"start": places[a] if places else a, "end": places[b] if places else b, "loose": False, "piece": v[a:b]})
        if loose_:
            seen = [Folded(t, loose_[1]) for t in texts]
            for i, a, b in loose_[0].find_all([f.low for f in seen]):
                if span := seen[i].edges(a, b):
                    hits[i].append({"start": span[0], "end": span[1], "loose": True, "piece": seen[i].low[a:b]})
        return pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("loose", pa.bool_()), ("piece", pa.string())])))

    @F.arrow_udf("string")
    def spliced(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
            if t is None or not own:
                out.append(t)
                continue
            parts, at = [], 0
            for h in sorted(own, key=lambda h: (h["start"], h["loose"], -h["end"])):
                if h["start"] >= at:
                    parts += (t[at : h["start"]], escaped(h["original"]) if mode == "json" else h["original"])
                    at = h["end"]
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    source = F.col(text)
    if mode == "text" and not tolerant and 0 < len(found.firsts) <= 64:  # texts without a first character of any surrogate stay in the JVM
        source = F.when(source.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in found.firsts) + "]"), source)
    seen = rows.select("_key", "_n", F.explode(look(source)).alias("h")).select("_key", "_n", "h.*")
    hit = seen.join(table, ["_key", "loose", "piece"]).groupBy("_n").agg(F.collect_list(F.struct("start", "end", "loose", "original")).alias("_hits"))
    joined = rows.join(hit, "_n", "left")
    changed = F.col("_hits").isNotNull()
    done = F.when(changed, spliced(F.when(changed, F.col(text)), F.col("_hits"))).otherwise(F.col(text))
    return joined.withColumn("restored", done).drop("_key", "_n", "_hits")
