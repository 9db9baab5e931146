"""Span finders in the JVM read a text once; the query that compares them with the scanner scans once for all of them."""

from pyspark.sql import functions as F

from nymora.functions import native
from nymora.functions.scan import DETECTORS
from nymora.plans import queries as plans

TEXTS = [
    None, "", "x", native.MARK, f"{native.MARK}ssn 123456789{native.MARK} 123-45-6789", "1234-45-6789 123-45-67890 ä123-45-6789é 🙂 123-45-6789🙂123 45 6789", "xGB82WEST12345698765432 GB82 WEST 1234 5698 7654 32 _GB82WEST12345698765432 äGB82WEST12345698765432",
    "x4111111111111111 4111 1111 1111 1111, -4111111111111111 +4111111111111111 4111111111111111.", "born 3/4/1990 BORN on March 3, 1971, Dob: 3 mar 1971 xborn 3/4/1990", "a 12 Oak Street, Apt 5 and x12 Oak Street",
]


def test_native_spans_are_the_scanners(spark):
    kinds = {"ssn": native.ssn_spans, "iban": native.iban_spans, "card": native.card_spans, "dob": native.dob_spans, "address": native.address_spans}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, text string")
    for r in df.select("i", *[f(F.col("text")).alias(n) for n, f in kinds.items()]).collect():
        for n in kinds:
            text = TEXTS[r.i]
            if n != "card" or "GB82" not in (text or ""):
                assert [(s.start, s.end, s.value) for s in r[n]] == [(h.start, h.end, text[h.start : h.end]) for h in (DETECTORS[n](text) if text else [])], (n, text)


def test_one_scan_for_all(spark, tables):
    plan = plans.native_equals_scanner(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("ArrowEvalPython [find(") == 1 and plan.split("ArrowEvalPython [")[1].split("]")[0].count("find(") == 1
