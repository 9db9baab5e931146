"""Column expressions: checks and span finders that stay inside the JVM. Offsets are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPAN = "array<struct<start:int,end:int,value:string>>"
SEEN = "array<struct<start:int,end:int,value:string,before:string>>"


#: Matches are walked in blocks of this size: an array that grows by one element at a time is copied each time.
BLOCK = 128

#: Stands around the matches of a text that doesn't hold it itself, so that one pass of the pattern tells matches and what is between them.
MARK = "\ue0a3"


def match_spans(text: Column, pattern: str, before: bool = False) -> Column:
    """array<struct<start, end, value>> of the matches of a pattern that never matches empty; with ``before``, also up to 32 characters
    before a match, counted from three matches earlier on at least.

    Offsets are running sums over the texts between matches and the matches, first of whole blocks, then within each: linear for any number of
    matches that a text can hold. ``regexp_instr`` would count UTF-16 units, and a substring counts from the text's begin each time.
    """
    size = lambda p: p["a"] + p["b"]
    none, empty = F.array().cast("array<int>"), F.array().cast(SPAN)
    pair = lambda g, m: F.struct(g.alias("g"), m.alias("m"), F.length(g).alias("a"), F.length(m).alias("b"))
    one = lambda at, p: F.struct((at + p["a"]).cast("int").alias("start"), (at + size(p)).cast("int").alias("end"), p["m"].alias("value"))

    def begins(totals: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(totals, start, lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def walked(block: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), empty.alias("out"))
        return F.aggregate(block, start, lambda acc, p: F.struct((acc["at"] + size(p)).alias("at"), F.concat(acc["out"], F.array(one(acc["at"], p))).alias("out")))["out"]

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, p: acc + size(p)))
        return F.flatten(F.zip_with(blocks, begins(totals), walked))

    def spans(pairs: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        out = let(F.transform(places, lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))), placed)
        if not before:
            return out
        last = lambda ends, i, k: F.when(i >= k, F.get(ends, i - k)).otherwise("")
        tail = lambda ends: F.transform(pairs, lambda p, i: F.right(F.concat(last(ends, i, 3), last(ends, i, 2), last(ends, i, 1), F.right(p["g"], F.lit(32))), F.lit(32)))
        heads = let(F.transform(pairs, lambda p: F.right(F.concat(p["g"], p["m"]), F.lit(32))), tail)
        return F.zip_with(out, heads, lambda s, h: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), h.alias("before")))

    found = lambda pairs: F.when(F.size(pairs) > 0, spans(pairs)).otherwise(F.array().cast(SEEN if before else SPAN))
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    places = lambda p: F.slice(F.sequence(F.lit(0), F.size(p) - 1, F.lit(2)), F.lit(1), F.shiftright(F.size(p), 1))
    once = let(parts, lambda p: F.transform(places(p), lambda i: pair(F.get(p, i), F.get(p, i + 1))))
    twice = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, pair))
    return let(F.when(text.contains(MARK), twice).otherwise(once), found)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; named in a lambda as it stands, it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain(spans: Column) -> Column:
    """Without what stands before."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def known_issuer(digits: Column) -> Column:
    tests = [digits.rlike(f"^(?:{prefix})") & F.length(digits).isin(*lengths) for prefix, lengths in fixed.ISSUERS]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def card_ok(value: Column) -> Column:
    """Digits alone or with spaces and dashes: 13 to 19, no leading 0, Luhn, and for solid digits a known issuer."""
    digits = F.regexp_replace(value, "[ -]", "")
    return F.length(digits).between(13, 19) & ~digits.startswith("0") & luhn_ok(digits) & ((digits != value) | known_issuer(digits))


def iban_ok(value: Column) -> Column:
    """Registered length and ISO 7064 MOD 97-10, by a running remainder over the digits."""
    iban = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    lengths = F.create_map(*[F.lit(x) for pair in fixed.IBAN_LENGTHS.items() for x in pair])
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    numbers = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(numbers, F.lit(0), lambda r, n: F.pmod(r * F.when(n > 9, 100).otherwise(10) + n, F.lit(97)))
    shaped = iban.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+\z")
    return F.coalesce(F.when(shaped & (F.element_at(lengths, F.substring(iban, 1, 2)) == F.length(iban)), rest == 1), F.lit(False))


def ssn_ok(area: Column, group: Column, serial: Column) -> Column:
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


def nanp_ok(value: Column) -> Column:
    return F.trim(value).rlike(rf"^(?:{fixed.NANP})\z")


def ipv4_ok(value: Column) -> Column:
    """Four octets without leading zeros that name a host: not 0.0.0.0, 127/8 or 240/4."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return value.rlike(rf"^{octet}(?:\.{octet}){{3}}\z") & ~value.rlike(r"^(?:127\.|2[45][0-9]\.|0\.0\.0\.0\z)")


def ipv4_spans(text: Column) -> Column:
    found = match_spans(text, r"(?U)(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w)(?!\.\d)", before=True)
    label = rf"(?i)(?U){fixed.VERSION_LABEL[:-1]}\n?\z"
    return plain(F.filter(found, lambda s: ipv4_ok(s["value"]) & ~F.right(s["before"], F.lit(16)).rlike(label)))


# Patterns begin with what most places fail; a look behind or a word's edge costs far more.
def ssn_spans(text: Column) -> Column:
    found = match_spans(text, r"(?U)\d(?<!\d\d)\d{2}([- ]?)\d{2}([- ]?)\d{4}(?!\d)", before=True)
    parts = r"^(\d{3})([- ]?)(\d{2})([- ]?)(\d{4})\z"

    def kept(s: Column) -> Column:
        g = [F.regexp_extract(s["value"], parts, i) for i in range(1, 6)]
        before = F.lower(F.right(s["before"], F.lit(25)))
        return (g[1] == g[3]) & ssn_ok(g[0], g[2], g[4]) & ((g[1] != "") | before.contains("ssn") | before.contains("social security"))

    return plain(F.filter(found, kept))


def iban_spans(text: Column) -> Column:
    return F.filter(match_spans(text, r"(?U)[A-Z](?<=\b[A-Z])[A-Z]\d{2}(?:[ ]?[A-Z0-9]{1,4}){2,7}\b"), lambda s: iban_ok(s["value"]))


def card_spans(text: Column) -> Column:
    pattern = fixed.CARD.replace("(?P<", "(?<").replace("(?P=sep)", r"\k<sep>").replace("(?P=sep2)", r"\k<sep2>")
    return plain(F.filter(match_spans(text, r"(?U)(?=\d)" + pattern, before=True), lambda s: card_ok(s["value"]) & ~s["before"].rlike("(?i)" + fixed.CARD_OTHER_LABEL)))


def dob_spans(text: Column) -> Column:
    near = lambda d, words: F.exists(words, lambda w: (F.abs(w["end"] - d["start"]) <= 30) | (F.abs(w["start"] - d["end"]) <= 30))
    kept = lambda words: F.when(F.size(words) > 0, F.filter(match_spans(text, r"(?i)(?=[\djfmasond])" + fixed.DATE), lambda d: near(d, words))).otherwise(F.array().cast(SPAN))
    return let(match_spans(text, "(?i)(?=[db])" + fixed.BIRTH_WORD), kept)


def address_spans(text: Column) -> Column:
    return match_spans(text, fixed.ADDRESS)
