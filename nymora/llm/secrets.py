r"""Secret scan with a randomness test battery, with DataFrame functions only.

Base spans come from three patterns (assign, access, hex). The battery adds spans of kind ``random``. It looks at runs of
``[A-Za-z0-9+/_=-]``, less what base spans cover of them, of ``min_run`` characters or more with a letter (shorter ones leave the
tests no power; digits alone are numbers). A run's encoding is the smallest alphabet that holds it. Under the hypothesis that its
characters are drawn evenly from that alphabet, it gets three p-values: a chi-squared test of uniformity (upper tail,
Wilson-Hilferty), a runs test above and below the middle of the alphabet, and a lag-1 serial correlation (both two-sided), combined
as 1 - (1 - min p)**3. A run of more than ``WINDOW`` characters is tested in windows that cover all of it; the least p-value,
times their number, counts.

What is reported are discoveries, and the error that is controlled is the share of false ones among them. The competing
hypothesis, that a run reads as words, paths or names, is given by decoys: every run has up to five, of its own length (at most
``DECOY`` characters), made from the prose before it in its own document: words glued by nothing, ``_``, ``-`` or ``/``, and capitalised. For each
encoding and class of length, the least p-value t is looked for at which (1 + decoys with p >= t) / (runs with p >= t), scaled by
runs per decoy of that class of length, is at most ``q``; runs with p >= t are secrets. Short runs, which the tests tell less
well from prose, thus need no rule of their own, and classes in which prose passes as often as runs report nothing. The bound holds as
far as false runs look like such decoys. It needs about 1 / (5 q) secrets of a class in the table, or reports none there.
P-values are counted over the whole table in ``BINS`` bins, so the rule needs a table of fixed size.

Positions are code points, ends exclusive. Matches meet their positions by a window over each document's own matches, in time
linear in them but for sorting. Defined cases: a null text is empty; repeated rows are scanned each; a text without any span gives
zeros and the hash of the empty text; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Lower-case strings one of which a text needs for an assignment.
NAMES = ("password", "passwd", "secret", "token", "api")
#: Classes of characters are spelled out, as the regex engine has a faster test for such.
ACCESS, HEX, RUN = "AKIA[A-Z0-9]+", "[0123456789abcdef]{24,}", "[ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-]"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by name: pattern of a run in it, and its characters in order.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", "^.*$", UPPER + LOWER + DIGITS + "+/-_="),
)
WINDOW, DECOY, BINS = 4096, 512, 1000
GLUES = ("", "_", "-", "/")
#: A run's class of length is the number of these that it reaches.
LENGTHS = (20, 28, 40, 64)
SPANS = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def _found(text: Column, pattern: str, kind: str, prose: bool = False, worth: Column | None = None) -> Column:
    """The leftmost non-overlapping matches in order: array<struct<kind, at, before, value, prose>>; before is the number of characters since the last one."""
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(gap: Column, value: Column) -> Column:
        near = F.call_function("right", gap, 2 * F.least(F.length(value), F.lit(DECOY)) + 32) if prose else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("before"), value.alias("value"), near.alias("prose"))

    empty = F.array().cast("array<struct<kind:string,before:int,value:string,prose:string>>")
    return F.when(text.rlike(pattern) if worth is None else worth & text.rlike(pattern), F.filter(F.zip_with(gaps, whole, one), lambda m: m["value"].isNotNull())).otherwise(empty)


def matches(docs: DataFrame, text: str, doc_id: str, min_run: int) -> DataFrame:
    """(doc_id, _row, found) of each row; _row tells the rows apart, found are all matches of all patterns."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    named = low.contains(NAMES[0])
    for name in NAMES[1:]:
        named = named | low.contains(name)
    found = F.concat(_found(t, ASSIGN, "assign", worth=named), _found(t, ACCESS, "access"), _found(t, HEX, "hex"), _found(t, f"{RUN}{{{min_run},}}", "random", True))
    return written(docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), found.alias("found")), "matches")


def positioned(found: DataFrame) -> DataFrame:
    """(_row, kind, start, end, value, prose) of every match."""
    each = found.where(F.size("found") > 0).select("_row", F.posexplode("found").alias("at", "m")).select("_row", "at", "m.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("at")
    length = F.length("value")
    placed = each.withColumn("end", F.sum((F.col("before") + length).cast("long")).over(so_far))
    return placed.select("_row", "kind", (F.col("end") - length).alias("start"), "end", "value", "prose")


def _uncovered(spans: DataFrame, min_run: int) -> DataFrame:
    """(_row, start, end, value, prose) of the parts of runs that no base span covers, by a sweep over each row's ends of spans."""
    run = F.col("kind") == "random"
    one = F.when(run, F.struct("start", "value", "prose"))
    step = lambda sign: F.struct(F.when(run, 0).otherwise(sign).alias("base"), F.when(run, sign).otherwise(0).alias("run"))
    ends = F.array(F.struct(F.col("start").alias("pos"), step(1).alias("by"), one.alias("of")), F.struct(F.col("end").alias("pos"), step(-1).alias("by"), F.lit(None).cast("struct<start:bigint,value:string,prose:string>").alias("of")))
    points = spans.select("_row", F.explode(ends).alias("p")).select("_row", "p.pos", "p.by", "p.of")
    order = Window.partitionBy("_row").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.withColumns({"base": F.sum("by.base").over(so_far), "run": F.sum("by.run").over(so_far), "next": F.lead("pos").over(order), "r": F.last("of", True).over(so_far)})
    part = swept.where((F.col("base") == 0) & (F.col("run") > 0) & (F.col("next") - F.col("pos") >= min_run))
    value = F.substring(F.col("r.value"), (F.col("pos") - F.col("r.start") + 1).cast("int"), (F.col("next") - F.col("pos")).cast("int"))
    return part.select("_row", F.col("pos").alias("start"), F.col("next").alias("end"), value.alias("value"), "r.prose").where(F.col("value").rlike("[A-Za-z]"))


def _normal_cdf(z: Column) -> Column:
    """The logistic approximation of the normal distribution, within 0.0002."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return 2 * (1 - _normal_cdf(F.abs(z)))


def battery(rows: DataFrame) -> DataFrame:
    """``rows`` with encoding, p_chi2, p_runs and p_serial of ``value``, a run of characters."""
    v = F.col("value")
    pick = lambda make: F.coalesce(*[F.when(v.rlike(pattern), make(name, letters)) for name, pattern, letters in ALPHABETS])
    alphabet = pick(lambda name, letters: F.struct(F.lit(name).alias("name"), F.lit(letters).alias("letters"), F.lit(float(len(letters))).alias("size")))
    rows = rows.withColumn("_a", alphabet).withColumn("encoding", F.col("_a.name"))
    bare = F.coalesce(F.nullif(F.regexp_replace(v, "=+$", ""), F.lit("")), v)  # padding isn't drawn
    own = F.when(F.col("encoding").isin("hex", "base36"), F.lower(bare)).otherwise(bare)
    size, letters = F.col("_a.size"), F.col("_a.letters")
    places = F.transform(F.split(own, ""), lambda c: F.position(c, letters).cast("double"))
    rows = rows.withColumn("_x", places).withColumn("_n", F.size("_x").cast("double"))
    x, n = F.col("_x"), F.col("_n")
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0)))
    pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("up")), lambda t, y: F.struct((t["s"] + y).alias("s"), (t["q"] + y * y).alias("q"), (t["up"] + F.when(y > size / 2, 1.0).otherwise(0.0)).alias("up")))
    turn = F.aggregate(pairs, F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("t")), lambda t, y: F.struct((t["p"] + y["a"] * y["b"]).alias("p"), (t["t"] + F.when((y["a"] > size / 2) != (y["b"] > size / 2), 1.0).otherwise(0.0)).alias("t")))
    rows = rows.withColumns({"_sq": squares, "_tot": total, "_turn": turn, "_ends": F.struct(F.get(x, F.lit(0)).alias("a"), F.element_at(x, -1).alias("b"))})
    chi2, df = size / n * F.col("_sq") - n, size - 1
    p_chi2 = 1 - _normal_cdf((F.pow(F.greatest(chi2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    ups = F.col("_tot.up")
    downs, runs = n - ups, 1 + F.col("_turn.t")
    mean = 2 * ups * downs / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when((ups == 0) | (downs == 0), F.pow(F.lit(0.5), n - 1)).when(var > 0, _two_sided((runs - mean) / F.sqrt(var))).otherwise(1.0)
    # Sums of (a - mu)(b - mu) over neighbours and of squares, from the plain sums.
    mu = F.col("_tot.s") / n
    product = F.col("_turn.p") - mu * (2 * F.col("_tot.s") - F.col("_ends.a") - F.col("_ends.b")) + (n - 1) * mu * mu
    power = F.col("_tot.q") - n * mu * mu
    p_serial = F.when(power > 1e-9, _two_sided((product / power + 1 / n) * F.sqrt(n))).otherwise(0.0)
    return rows.withColumns({"p_chi2": p_chi2, "p_runs": p_runs, "p_serial": p_serial}).drop("_a", "_x", "_n", "_sq", "_tot", "_turn", "_ends")


def judged(runs: DataFrame, q: float, min_run: int) -> DataFrame:
    """The rows of ``runs`` (_row, start, end, value, prose) that are secrets."""
    length = F.length("value")
    keyed = runs.withColumn("length_class", sum((length >= at).cast("int") for at in LENGTHS))
    most = F.least(length, F.lit(DECOY))
    glued = [F.regexp_replace("prose", "[^A-Za-z0-9]+", glue) for glue in GLUES]
    glued.append(F.replace(F.initcap(F.regexp_replace("prose", "[^A-Za-z0-9]+", " ")), F.lit(" "), F.lit("")))
    decoy = F.array(*[F.call_function("right", g, most) for g in glued])
    decoys = keyed.select("_row", "start", "end", "length_class", F.explode(F.filter(decoy, lambda d: (F.length(d) >= min_run) & d.rlike("[A-Za-z]"))).alias("value"))
    both = keyed.select("_row", "start", "end", "length_class", "value", F.lit(False).alias("decoy")).unionByName(decoys.withColumn("decoy", F.lit(True)))
    n = F.ceil(F.length("value") / WINDOW)
    cut = both.withColumn("n", n.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda i: F.floor(i * F.length("value") / F.col("n")).cast("int")
    parts = cut.withColumn("value", F.substring(F.col("value"), at(F.col("i")) + 1, at(F.col("i") + 1) - at(F.col("i"))))
    least = F.least("p_chi2", "p_runs", "p_serial")
    tested = battery(parts).withColumn("p", F.greatest(F.lit(0.0), 1 - F.pow(1 - F.least(F.lit(1.0), least), F.lit(3.0))))
    # Runs of one window, nearly all, need no grouping.
    one = tested.where("n = 1").select("_row", "start", "end", "length_class", "decoy", "encoding", "p")
    rest = tested.where("n > 1").groupBy("_row", "start", "end", "length_class", "decoy").agg(F.max("encoding").alias("encoding"), F.least(F.lit(1.0), F.min("p") * F.max("n")).alias("p"))
    binned = written(one.unionByName(rest).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int")), "tested")
    counts = binned.groupBy("encoding", "length_class", "bin").agg(F.count_if(~F.col("decoy")).alias("t"), F.count_if("decoy").alias("d"))
    down = Window.partitionBy("encoding", "length_class").orderBy(F.desc("bin"))
    all_ = Window.partitionBy("length_class")
    ranked = counts.withColumns({"ts": F.sum("t").over(down), "ds": F.sum("d").over(down), "share": F.sum("t").over(all_) / F.greatest(F.sum("d").over(all_), F.lit(1))})
    limits = ranked.where((1 + F.col("ds")) * F.col("share") <= q * F.col("ts")).groupBy("encoding", "length_class").agg(F.min("bin").alias("least_bin"))
    return binned.where(~F.col("decoy")).join(F.broadcast(limits), ["encoding", "length_class"]).where("bin >= least_bin").select("_row", "start", "end")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", q: float = 0.05, min_run: int = 16) -> DataFrame:
    """(doc_id, base, random) of each row: its base spans and the battery's, as array<struct<start, end, kind, value>>."""
    found = matches(docs, text, doc_id, min_run)
    spans = written(positioned(found), "spans")
    kind, value = F.col("kind"), F.col("value")
    good = ((kind == "assign") & (F.length(F.regexp_extract(value, ASSIGN, 2)) >= 6)) | ((kind == "access") & (F.length(value) >= 20)) | (kind == "hex") | (kind == "random")
    spans = spans.where(good)
    runs = written(_uncovered(spans, min_run), "runs")
    random = judged(runs, q, min_run).join(runs.drop("prose"), ["_row", "start", "end"]).withColumn("kind", F.lit("random"))
    every = spans.where("kind <> 'random'").select("_row", "start", "end", "kind", "value").unionByName(random.select("_row", "start", "end", "kind", "value"))
    by_row = every.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "value"))).alias("s"))
    held = lambda keep: F.coalesce(F.filter("s", keep), F.array().cast(SPANS))
    joined = found.select("doc_id", "_row").join(by_row, "_row", "left")
    return joined.select("doc_id", held(lambda s: s["kind"] != "random").alias("base"), held(lambda s: s["kind"] == "random").alias("random"))


def _listed(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from ``scan``."""
    number = {f"n_{kind}": F.expr(f"size(filter(base, s -> s.kind = '{kind}'))").cast("long") for kind in KINDS[:3]}
    return found.select("doc_id", *[c.alias(n) for n, c in number.items()], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "random")).alias("spans"))
