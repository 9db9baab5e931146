"""JSON documents and chat messages as batches: their strings become rows of a masking or restoring batch, and go back in place."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed
from ..functions.messages import STYLES, parts, rebuilt
from ..sources.vault import VaultError
from . import mask as masking
from . import restore as restoring
from .detect import entities
from .tables import stored

PARTS = "struct<parts:array<struct<token:int,inner:int,text:string,field:string,is_key:boolean>>,error:string>"
ARROW = pa.struct([("parts", pa.list_(pa.struct([("token", pa.int32()), ("inner", pa.int32()), ("text", pa.string()), ("field", pa.string()), ("is_key", pa.bool_())]))), ("error", pa.string())])


def document_parts(style: str):
    """A column function: the strings of a document, or why it can't be read."""
    if style not in STYLES:
        raise ValueError(f"style is one of {STYLES}")

    @F.arrow_udf(PARTS)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append({"parts": [p._asdict() for p in parts(t, style)] if t is not None else [], "error": None})
            except RecursionError:
                out.append({"parts": [], "error": "nested too deeply"})
            except ValueError as e:
                out.append({"parts": [], "error": str(e) if type(e) is not ValueError and "JSONContext" in type(e).__name__ else "not a complete JSON document"})
        return pa.array(out, ARROW)

    return find


@F.arrow_udf(StringType())
def _rebuild(texts: pa.Array, values: pa.Array) -> pa.Array:
    out = [t if not v else rebuilt(t, {(x["token"], x["inner"]): x["value"] for x in v}) for t, v in zip(texts.to_pylist(), values.to_pylist(), strict=True)]
    return pa.array(out, pa.string())


def _whole(text, values):
    """``text`` with its values; texts in which none changes stay in the JVM."""
    some = values.isNotNull()
    return F.when(some, _rebuild(F.when(some, text), F.when(some, values))).otherwise(text)


def mask_documents(df: DataFrame, vault: DataFrame, text: str = "text", ord: str = "ord", vault_id: str | None = None, style: str = "values", detectors: Iterable[str] = fixed.DEFAULT_DETECTORS, **options) -> tuple[DataFrame, DataFrame]:
    """(``df`` with masked, the grown vault). A document that can't be read, or with personal data in a key, raises VaultError."""
    key = restoring.key_of(vault_id)
    read = stored(df.withColumn("_v", key).withColumn("_o", F.struct(F.col(ord).alias("ord"), F.monotonically_increasing_id().alias("row"))).withColumn("_p", document_parts(style)(F.col(text))))
    errors = [r[0] for r in read.where("_p.error is not null").select("_p.error").distinct().limit(5).collect()]
    if errors:
        raise VaultError("; ".join(sorted(errors)))
    each = read.select("_v", "_o", F.explode("_p.parts").alias("p"))
    if each.where("p.is_key").where(F.size(entities(F.col("p.text"), None, detectors, options.get("names", ()))) > 0).limit(1).count():
        raise VaultError("a JSON key holds personal data; use another field name")
    rows = each.where("not p.is_key").select("_v", F.struct(F.col("_o").alias("o"), F.col("p.token").alias("token"), F.col("p.inner").alias("inner")).alias("_at"), F.col("p.text").alias("_t"), F.col("p.field").alias("_f"))
    masked, grown = masking.mask(rows, vault, "_t", "_at", "_v", "_f", detectors, **options)
    values = masked.where("masked <> _t").groupBy(F.col("_at.o.row").alias("_row")).agg(F.collect_list(F.struct("_at.token", "_at.inner", F.col("masked").alias("value"))).alias("_values"))
    joined = read.withColumn("_row", F.col("_o.row")).join(values, "_row", "left")
    return joined.withColumn("masked", _whole(F.col(text), F.col("_values"))).drop("_v", "_o", "_p", "_values", "_row"), grown


def restore_documents(df: DataFrame, vault: DataFrame, text: str = "masked", vault_id: str | None = None, style: str = "values", tolerant: bool = True) -> DataFrame:
    """``df`` with restored. Complete documents are restored value by value; malformed ones by the streaming lexer, as far as it goes."""
    key = restoring.key_of(vault_id)
    read = stored(df.withColumn("_v", key).withColumn("_row", F.monotonically_increasing_id()).withColumn("_p", document_parts(style)(F.col(text))))
    each = read.where("_p.error is null").select("_v", "_row", F.explode("_p.parts").alias("p")).where("not p.is_key").select("_v", "_row", "p.token", "p.inner", F.col("p.text").alias("_t"))
    back = restoring.restore(each, vault, "_t", "_v", tolerant).where("restored <> _t")
    values = back.groupBy("_row").agg(F.collect_list(F.struct("token", "inner", F.col("restored").alias("value"))).alias("_values"))
    whole = read.join(values, "_row", "left").withColumn("_whole", _whole(F.col(text), F.col("_values"))).withColumn("_cut", F.when(F.col("_p.error").isNotNull(), F.col(text)))
    lexed = restoring.restore(whole, vault, "_cut", "_v", False, "json")
    return lexed.withColumn("restored", F.when(F.col("_p.error").isNull(), F.col("_whole")).otherwise(F.col("restored"))).drop("_v", "_row", "_p", "_values", "_whole", "_cut")
