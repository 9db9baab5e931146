"""Masking a batch: detect, mint surrogates for new values, rewrite, verify.

A batch is a DataFrame with ``vault_id`` and ``ord``, the reading order within a vault: null comes first, equal ones by their place in the table. A null
vault_id names the default vault, ''. All source texts of a vault are reserved before anything is minted: a surrogate that any of them holds, whatever its case and spacing, is skipped.
Nothing is kept until the batch has been verified; ``mask`` raises VaultError and changes nothing otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType

from ..functions import fixed
from ..functions.surrogates import Placeholders
from ..sources.store import VaultStore, grow
from ..sources.vault import VaultError
from . import restore as restoring
from .detect import entities
from .spans import rewrite
from .tables import numbered, stored
from .windows import nominated

ATTEMPTS = 1024


@F.pandas_udf(StringType())
def spelling(texts: pd.Series) -> pd.Series:
    """White space collapsed and case folded: what tolerant restoration can't tell apart."""
    return texts.map(lambda t: None if t is None else " ".join(t.split()).casefold())


def prepared(df: DataFrame, text: str, ord: str, vault_id: str | None) -> DataFrame:
    return df.withColumns({"_vault": restoring.key_of(vault_id), "_ord": F.struct(F.col(ord).alias("ord"), F.monotonically_increasing_id().alias("row")), "_text": F.col(text)})


def _literals(sources: DataFrame, generator: Placeholders) -> DataFrame:
    """(_vault, type, n) of numbers whose placeholder occurs in some source; only texts with the template's marks reach Python."""
    pattern = re.escape(generator.template).replace(r"\{type\}", "{type}").replace(r"\{n\}", "{n}")
    pattern = re.sub(r"(\\ )+", r"\\s+", pattern)
    folded = pattern.casefold().format(type="([a-z0-9_]+?)", n="([0-9]+)") if "{type}" in pattern else "()" + pattern.casefold().format(n="([0-9]+)")
    mark = generator.template.split("{")[0].strip()
    some = sources.where(F.lower("_text").contains(mark.lower())) if mark else sources
    found = some.select("_vault", F.explode(F.regexp_extract_all(spelling("_text"), F.lit(folded), F.lit(0))).alias("m"))
    kind, n = F.upper(F.regexp_extract("m", folded, 1)), F.regexp_extract("m", folded, 2)
    types = found.select("_vault", kind.alias("type"), n.alias("digits")) if "{type}" in generator.template else found.select("_vault", F.explode(F.array(*map(F.lit, fixed.TYPES))).alias("type"), n.alias("digits"))
    return types.where((F.length("digits") <= 18) & ~F.col("digits").startswith("0")).select("_vault", "type", F.col("digits").cast("long").alias("n")).distinct()


def mint(values: DataFrame, vault: DataFrame, sources: DataFrame, generator) -> DataFrame:
    """New rows of the vault. values: _vault, type, value, _ord, start, detector of every occurrence; sources: _vault, _text."""
    first = values.groupBy("_vault", "type", "value").agg(F.min_by("detector", F.struct("_ord", "start")).alias("detector"), F.min(F.struct("_ord", "start")).alias("at"))
    known = vault.select(F.col("vault_id").alias("_vault"), "type", F.col("original").alias("value"))
    fresh = numbered(first.join(known, ["_vault", "type", "value"], "left_anti"), ["_vault", "type"], ["at"], "k")
    counts = vault.groupBy(F.col("vault_id").alias("_vault"), "type").agg(F.count(F.lit(1)).alias("base"))
    # Spare numbers: those of surrogates in the vault are skipped along with the reserved ones.
    based = fresh.join(counts, ["_vault", "type"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    if isinstance(generator, Placeholders) and generator.delimited:
        own = vault.select(F.col("vault_id").alias("_vault"), F.col("surrogate").alias("_text"))
        originals = vault.select(F.col("vault_id").alias("_vault"), F.col("original").alias("_text"))
        taken = _literals(sources.select("_vault", "_text").unionByName(own).unionByName(originals), generator)
        after = taken.join(counts, ["_vault", "type"], "left").where(F.col("n") > F.coalesce("base", F.lit(0)))
        reserved = after.groupBy("_vault", "type").agg(F.sort_array(F.collect_set("n")).alias("reserved"))
        based = based.join(reserved, ["_vault", "type"], "left")
        # The k-th number after base that isn't reserved: reserved number j (from 0) has reserved[j] - base - 1 - j free ones before it.
        gaps = F.transform(F.coalesce("reserved", F.array().cast("array<long>")), lambda r, j: r - F.col("base") - 1 - j)
        n = F.col("base") + F.col("k") + F.size(F.filter(gaps, lambda g: g < F.col("k")))
        minted = based.withColumn("surrogate", generator.column(F.col("type"), F.col("value"), n))
    else:
        minted = _tried(based, vault, sources, generator)
    last = vault.groupBy(F.col("vault_id").alias("_vault")).agg((F.max("ord") + 1).alias("next"))
    placed = numbered(minted.select("_vault", "type", "value", "surrogate", "detector", "at"), ["_vault"], ["at"], "_place").join(last, "_vault", "left")
    return placed.select(F.col("_vault").alias("vault_id"), (F.coalesce("next", F.lit(0)) + F.col("_place") - 1).alias("ord"), "type", F.col("value").alias("original"), "surrogate", "detector")


def _tried(based: DataFrame, vault: DataFrame, sources: DataFrame, generator) -> DataFrame:
    """Numbers for surrogates without delimiters: candidates are made with spare numbers, those that a source or the vault holds
    go, and the k-th of the rest is the k-th value's. A source is tested by those of its windows that pass a bit map of
    the candidates, joined by equality."""
    wanted = based.groupBy("_vault", "type").agg(F.max("k").alias("most"), F.first("base").alias("base"))
    spare = F.least(F.lit(ATTEMPTS), F.lit(64) + F.col("most"))
    tried = wanted.select("_vault", "type", F.explode(F.sequence(F.col("base") + 1, F.col("base") + F.col("most") + spare)).alias("n"))
    named = stored(tried.withColumn("surrogate", generator.column(F.col("type"), F.lit(""), F.col("n"))).withColumn("folded", spelling("surrogate")))
    taken = vault.select(F.col("vault_id").alias("_vault"), "surrogate")
    free = named.join(taken, ["_vault", "surrogate"], "left_anti")
    texts = sources.select("_vault", "_text").unionByName(vault.select(F.col("vault_id").alias("_vault"), F.col("original").alias("_text")))
    folded = texts.select("_vault", spelling("_text").alias("t"))
    held = nominated(folded, "t", ["_vault"], free.select("folded"), "folded").select("_vault", F.col("piece").alias("folded"))
    free = free.join(held.distinct(), ["_vault", "folded"], "left_anti")
    ranked = numbered(free.dropDuplicates(["_vault", "surrogate"]), ["_vault", "type"], ["n"], "k")
    out = based.join(ranked.select("_vault", "type", "k", "surrogate"), ["_vault", "type", "k"], "left")
    if out.where("surrogate is null").limit(1).count():
        raise VaultError("the generator has no available surrogates left; use numbered placeholders")
    return out


def mask(
    df: DataFrame,
    vault: DataFrame,
    text: str = "text",
    ord: str = "ord",
    vault_id: str | None = None,
    field: str | None = None,
    detectors: Iterable[str] = fixed.DEFAULT_DETECTORS,
    names: Iterable = (),
    generator=None,
    verify: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(``df`` with masked and entities, the vault with what was minted)."""
    masked, new = masked_and_new(df, vault, text, ord, vault_id, field, detectors, names, generator, verify)
    return masked, vault.unionByName(new)


def masked_and_new(df: DataFrame, vault: DataFrame, text: str = "text", ord: str = "ord", vault_id: str | None = None, field: str | None = None, detectors: Iterable[str] = fixed.DEFAULT_DETECTORS, names: Iterable = (), generator=None, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``df`` with masked and entities, the mappings that were minted)."""
    generator = generator or Placeholders()
    found = stored(prepared(df, text, ord, vault_id).withColumn("entities", entities("_text", field, detectors, names)))
    each = found.select("_vault", "_ord", F.explode("entities").alias("e")).select("_vault", "_ord", "e.*")
    new = stored(mint(each, vault, found, generator))
    grown = vault.unionByName(new)
    lookup = grown.select(F.col("vault_id").alias("_vault"), "type", F.col("original").alias("value"), "surrogate")
    change = F.struct("start", "end", "surrogate")
    changes = each.join(lookup, ["_vault", "type", "value"]).groupBy(F.col("_ord.row").alias("_row")).agg(F.sort_array(F.collect_list(change)).alias("_changes"))
    joined = found.withColumn("_row", F.col("_ord.row")).join(changes, "_row", "left")
    none = F.array().cast("array<struct<start:int,end:int,surrogate:string>>")
    masked = stored(joined.withColumn("masked", rewrite(F.col("_text"), F.coalesce("_changes", none))))
    if masked.where(F.size("entities") != F.coalesce(F.size("_changes"), F.lit(0))).limit(1).count():
        raise VaultError("a value that was found has no surrogate, or several")
    if verify:
        _verify(masked, grown, generator)
    return masked.drop("_vault", "_ord", "_text", "_changes", "_row"), new


def mask_into(store: VaultStore, df: DataFrame, tag: str = "", **options) -> DataFrame:
    """``df`` masked with the store's vault, which other writers may grow at the same time; ``options`` as in ``mask``."""
    return grow(store, lambda vault: masked_and_new(df, vault, **options), tag)


def mask_stream(rows: DataFrame, store: VaultStore, out: str, name: str, **options) -> DataStreamWriter:
    """A writer that masks each micro-batch into ``out``/batch=<id>; a batch that runs again, after a failure, finds its mappings and replaces its files."""

    def batch(df: DataFrame, number: int) -> None:
        mask_into(store, stored(df), f"{name}/{number}", **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.queryName(name).foreachBatch(batch)


def _verify(masked: DataFrame, grown: DataFrame, generator) -> None:
    """Exact and tolerant restoration must both give every source back.

    Where every surrogate holds the template's mark, a text that was left as it is and doesn't hold it can't change.
    """
    mark = generator.template.split("{")[0].strip().lower() if isinstance(generator, Placeholders) and generator.delimited else ""
    rows = masked.select("_vault", F.col("masked").alias("_m"), "_text")
    if mark and not grown.where(~F.lower("surrogate").contains(mark)).limit(1).count():
        rows = rows.where((F.col("_m") != F.col("_text")) | F.lower("_m").contains(mark))
    if restoring.unfaithful(rows, grown, "_m", "_text", "_vault").limit(1).count():
        raise VaultError("a source would change in restoration, as it holds text like a surrogate; mask the whole input with a new vault")
