"""Text columns to entities: one Arrow function runs all detectors over a row, behind a native test for anything to find."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scan import DETECTORS, NEED_DIGIT, scan
from ..functions.secrets import KEY_FORMATS
from .spans import ENTITIES

ARROW = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detector", pa.string()), ("confidence", pa.float64())]))
#: Every default detector needs one of these; the text of a row without any isn't sent to Python. Key formats come with their marks, and a compact JWT has
#: two dots among its characters, however short its parts.
SIGNAL = r"(?U)[@:+]|\d\D{0,2}\d|(?i:key|pass|secret|token|cookie|authorization)|[A-Za-z0-9+/_=.-]{20}|ey[A-Za-z0-9_=-]*\.[A-Za-z0-9_=-]+\.|" + "|".join(re.escape(mark) for _, marks, _ in KEY_FORMATS for mark in marks)
ADDRESS_SIGNAL = r"|(?U)\d[A-Za-z]?\s"
#: What is enough where every detector's values hold digits: two at most two characters apart; an address may have a single one.
DIGITS, DIGIT = r"\p{Nd}\P{Nd}{0,2}\p{Nd}", r"\p{Nd}"


def signal(detectors: Iterable[str]) -> str:
    """The pattern of which any value of these detectors holds a match."""
    if NEED_DIGIT.issuperset(detectors):
        return DIGIT if "address" in detectors else DIGITS
    return SIGNAL + (ADDRESS_SIGNAL if "address" in detectors else "")


def checked(detectors: Iterable[str]) -> list[str]:
    detectors = list(detectors)
    if unknown := [d for d in detectors if d not in DETECTORS]:
        raise ValueError(f"unknown detectors: {', '.join(unknown)}")
    return detectors


def _rows(texts: pa.Array, fields: pa.Array | None, detectors, names, resolved) -> pa.Array:
    out = []
    for i, text in enumerate(texts.to_pylist()):
        hits = scan(text, detectors, names, fields[i].as_py() if fields is not None else None, resolved)
        out.append([{"type": h.type, "value": text[h.start : h.end], "start": h.start, "end": h.end, "detector": h.detector, "confidence": h.confidence} for h in hits])
    return pa.array(out, ARROW)


def entities(text: Column | str, field: Column | str | None = None, detectors: Iterable[str] = fixed.DEFAULT_DETECTORS, names: Iterable = (), resolved: bool = True) -> Column:
    """array<ENTITY> of each text; ``field`` is a column with the immediate field name, ``names`` are name backends."""
    detectors, names = checked(detectors), list(names)
    text = F.col(text) if isinstance(text, str) else text
    field = F.col(field) if isinstance(field, str) else field
    empty = F.array().cast(ENTITIES)
    if not names:
        # A function under a condition is computed for every row, so its argument is nulled: texts without a signal don't travel.
        worth = text.rlike(signal(detectors))
        text = F.when(worth if field is None else worth | field.isNotNull(), text)
    if field is None:

        @F.arrow_udf(ENTITIES)
        def find(texts: pa.Array) -> pa.Array:
            return _rows(texts, None, detectors, names, resolved)

        found = find(text)
    else:

        @F.arrow_udf(ENTITIES)
        def find_in(texts: pa.Array, fields: pa.Array) -> pa.Array:
            return _rows(texts, fields, detectors, names, resolved)

        found = find_in(text, field)
    return F.coalesce(found, empty)


def detect(df: DataFrame, text: str = "text", field: str | None = None, **options) -> DataFrame:
    """``df`` with ``entities``."""
    return df.withColumn("entities", entities(text, field, **options))
