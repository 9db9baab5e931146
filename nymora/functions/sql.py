"""The engine as SQL: temporary functions and a table function."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed, scan
from .lookup import Lookup, restore

ENTITY = "struct<type:string,value:string,start:int,end:int,detector:string,confidence:double>"


def register(spark: SparkSession, vault: DataFrame | None = None, max_mappings: int = 200_000) -> None:
    """detect_pii, luhn_ok, iban_ok, ssn_ok, nanp_ok and the table function pii_entities; with a vault, mask_pii, restore_pii and audit_pii.

    mask_pii replaces what the vault knows; new values are minted by ``Engine.mask``, which sees the whole batch. The vault is counted
    before it is broadcast.
    """
    from ..operators.audit import ARROW as FOUND
    from ..operators.audit import FINDING, Known
    from ..operators.detect import _rows

    @F.arrow_udf(f"array<{ENTITY}>")
    def detect_pii(texts: pa.Array) -> pa.Array:
        return _rows(texts, None, fixed.DEFAULT_DETECTORS, (), True)

    @F.arrow_udf(f"array<{ENTITY}>")
    def detect_pii_field(texts: pa.Array, fields: pa.Array) -> pa.Array:
        return _rows(texts, fields, fixed.DEFAULT_DETECTORS, (), True)

    def checks(name: str, test):
        @F.pandas_udf("boolean")
        def check(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else test(v))

        spark.udf.register(name, check)

    spark.udf.register("detect_pii", detect_pii)
    spark.udf.register("detect_pii_field", detect_pii_field)
    checks("luhn_ok", lambda v: v.isdigit() and scan.luhn_ok(v))
    checks("iban_ok", scan.iban_ok)
    checks("ssn_ok", lambda v: any(h.start == 0 and h.end == len(v) for h in scan.find_ssn(v)) or len(v) == 9 and v.isdigit() and scan.ssn_ok(v[:3], v[3:5], v[5:]))
    checks("nanp_ok", lambda v: bool(scan._nanp.fullmatch(v.strip())))

    @F.udtf(returnType="type: string, value: string, start: int, end: int, detector: string, confidence: double")
    class PiiEntities:
        def eval(self, text: str):
            for h in scan.scan(text):
                yield h.type, text[h.start : h.end], h.start, h.end, h.detector, h.confidence

    spark.udtf.register("pii_entities", PiiEntities)
    if vault is None:
        return
    if vault.limit(max_mappings + 1).count() > max_mappings:
        raise ValueError(f"more than {max_mappings} mappings; use the engine's joins")
    rows = spark.sparkContext.broadcast([tuple(r) for r in vault.orderBy("vault_id", "ord").select("type", "original", "surrogate").collect()])
    made: dict = {}

    def once(name: str, make):
        if name not in made:
            made[name] = make(rows.value)
        return made[name]

    @F.pandas_udf("string")
    def mask_pii(texts: pd.Series) -> pd.Series:
        known = once("mask", lambda r: {(t, o): s for t, o, s in r})

        def masked(t):
            if t is None:
                return None
            out, at = [], 0
            for h in scan.scan(t):
                out += [t[at : h.start], known.get((h.type, t[h.start : h.end]), t[h.start : h.end])]
                at = h.end
            return "".join([*out, t[at:]])

        return texts.map(masked)

    @F.pandas_udf("string")
    def restore_pii(texts: pd.Series) -> pd.Series:
        lookup = once("restore", lambda r: Lookup((s, o) for _, o, s in r))
        return texts.map(lambda t: None if t is None else restore(t, lookup))

    @F.arrow_udf(f"array<{FINDING}>")
    def audit_pii(texts: pa.Array) -> pa.Array:
        known = once("audit", Known)
        found = ([*known.leaks(t), *known.news(t, list(fixed.DEFAULT_DETECTORS))] if t else [] for t in texts.to_pylist())
        return pa.array([sorted(f, key=lambda x: x["start"]) for f in found], FOUND)

    for name, f in (("mask_pii", mask_pii), ("restore_pii", restore_pii), ("audit_pii", audit_pii)):
        spark.udf.register(name, f)
