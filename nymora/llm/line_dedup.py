"""Line dedup by a log-template tree, with DataFrame functions only.

A line is split at spaces; tokens with a digit are variable fields and become ``<*>``. The tree has a fixed depth: the token count,
then the first ``depth`` tokens. In a leaf that ``min_docs`` documents share, a position whose commonest token covers less than
half of the lines is a variable field too, if the leaf's constant positions make up ``similarity`` of the tokens at least (the
lines are then one template); otherwise each line is its own template. A template recurs when ``min_docs`` different texts hold
it; copies of a text count once. One of ``long_tokens`` tokens or more also recurs when ``long_docs`` different texts hold it in
different surroundings: the distinct lines before it, or those after it, number ``long_docs``, or more than half of the texts.
Recurring lines are no surroundings, so a block is taken from its ends inwards; at a text's edge the line on the other side
stands in for the missing one. Lines of recurring templates with ``min_tokens`` tokens or more are dropped
from every document, whatever share of its lines they are.

Lines are compared by 64-bit hashes. Texts are shuffled once, to meet the numbers of their dropped lines; a line that a
third of all documents holds is a key of pre-aggregated counts and of skewed joins that adaptive execution splits, and sets of
templates and leaves are broadcast only when counted to be at most ``broadcast_rows``.

Defined cases: a null text stays null and has no lines; an empty text has one empty line, which is never dropped; rows with the same
doc_id and text lose the same lines and count as one document; an empty table gives no rows; if all lines go, the text is
empty; columns of the input named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

VARIABLE = "<*>"


def _masked(line: Column) -> Column:
    """The line with its digit-bearing tokens as VARIABLE; most lines have none and aren't rewritten."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<! )[^ 0-9]*+[0-9][^ ]*|(?<= )[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(line)


def _size(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(row, copy, at, size, leaf, line) of every line; copy is the hash of the text, line of the masked line, leaf of its leading tokens."""
    masked = F.transform(F.split("text", "\n"), _masked)
    rows = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("copy"), masked.alias("l"))
    exploded = rows.select("row", "copy", F.posexplode("l").alias("at", "line"))
    return exploded.select(
        "row",
        "copy",
        "at",
        _size(F.col("line")).alias("size"),
        F.xxhash64(F.substring_index("line", " ", depth)).alias("leaf"),
        F.xxhash64("line").alias("line"),
    )


def _texts(docs: DataFrame, depth: int) -> DataFrame:
    """(leaf, size, text) of every masked line."""
    every = docs.select(F.explode(F.split("text", "\n")).alias("text")).select(_masked(F.col("text")).alias("text"))
    return every.select(F.xxhash64(F.substring_index("text", " ", depth)).alias("leaf"), _size(F.col("text")).alias("size"), "text")


def _small(df: DataFrame, broadcast_rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df


def _variable_positions(lines: DataFrame, docs: DataFrame, min_docs: int, min_tokens: int, depth: int, similarity: float, broadcast_rows: int) -> DataFrame:
    """(leaf, size, fields): the variable positions of leaves that hold one template with variable fields beyond those with digits."""
    leaves = lines.where(F.col("size") >= min_tokens).groupBy("leaf", "size").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    leaves = written(leaves.where((F.col("n") >= min_docs) & (F.col("lo") != F.col("hi"))).select("leaf", "size"), "leaves")
    held = _texts(docs, depth).join(_small(leaves, broadcast_rows), ["leaf", "size"])
    tokens = held.select("leaf", "size", F.posexplode(F.split("text", " ")).alias("at", "token"))
    counts = tokens.groupBy("leaf", "size", "at", F.xxhash64("token").alias("token")).agg(F.count(F.lit(1)).alias("c"))
    modes = counts.groupBy("leaf", "size", "at").agg(F.max("c").alias("most"), F.sum("c").alias("all"))
    by_leaf = modes.groupBy("leaf", "size").agg(F.sort_array(F.collect_list(F.when(2 * F.col("most") < F.col("all"), F.col("at")))).alias("fields"))
    return by_leaf.where((F.size("fields") > 0) & (F.size("fields") <= F.col("size") * (1 - similarity)))


def recurring(
    docs: DataFrame, min_docs: int = 10, min_tokens: int = 3, long_docs: int = 3, long_tokens: int = 50, depth: int = 3, similarity: float = 0.6, broadcast_rows: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """(lines with their template, templates that recur); docs: doc_id, text."""
    lines = written(_lines(docs, depth), "lines")
    fields = written(_variable_positions(lines, docs, min_docs, min_tokens, depth, similarity, broadcast_rows), "fields")
    if fields.limit(1).count():
        lines = written(_generalised(lines, docs, fields, depth, broadcast_rows), "templates")
    else:
        lines = lines.withColumn("template", F.col("line"))
    # Templates with too few lines go first, by a plain count; what is left is counted by different texts.
    long = lines.where(F.col("size") >= min_tokens)
    enough = F.when(F.col("size") >= long_tokens, min(long_docs, min_docs)).otherwise(min_docs)
    many = long.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    many = written(many.where(F.col("n") >= enough).select("template"), "many")
    once = long.join(_small(many, broadcast_rows), "template", "left_semi").groupBy("template", "copy").agg(F.min("row").alias("row"), F.max("size").alias("size"))
    once = written(once, "held")
    counts = once.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.max("size").alias("size"))
    counts = written(counts.where(F.col("docs") >= enough), "counts")
    found = written(counts.where(F.col("docs") >= min_docs).select("template", "docs"), "recurring")
    few = written(counts.where(F.col("docs") < min_docs).select("template", "docs"), "few")
    return lines, _surrounded(lines, once, found, few, long_docs, broadcast_rows)


def _surrounded(lines: DataFrame, once: DataFrame, found: DataFrame, few: DataFrame, long_docs: int, broadcast_rows: int) -> DataFrame:
    """``found`` and those templates of ``few`` (template, docs) that recur by their surroundings, taken in rounds until no more recur."""
    if not few.limit(1).count():
        return found
    held = written(once.join(_small(few, broadcast_rows), "template", "left_semi").select("row").distinct(), "holders")
    whole = written(lines.join(_small(held, broadcast_rows), "row", "left_semi").select("row", "at", "line", "template").distinct(), "whole")
    up, down = (Window.partitionBy("row").orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in (F.asc("at"), F.desc("at")))
    while True:
        marked = whole.join(_small(found.select("template", F.lit(True).alias("gone")), broadcast_rows), "template", "left")
        other = F.when(F.col("gone").isNull(), F.col("line"))
        around = marked.withColumns({"up": F.last(other, True).over(up), "down": F.last(other, True).over(down)})
        sides = around.select("template", "row", F.coalesce("up", F.xxhash64("down", F.lit(1)), F.lit(0)).alias("before"), F.coalesce("down", F.xxhash64("up", F.lit(1)), F.lit(0)).alias("after"))
        by_text = sides.join(_small(few, broadcast_rows), "template").groupBy("template", "row").agg(F.min("docs").alias("docs"), F.min("before").alias("before"), F.min("after").alias("after"))
        # Fewer than min_docs texts hold a template here, so its sets are small.
        number = F.greatest(F.size(F.collect_set("before")), F.size(F.collect_set("after"))).alias("n")
        more = by_text.groupBy("template").agg(F.min("docs").alias("docs"), number)
        more = written(more.where((F.col("n") >= long_docs) | (2 * F.col("n") > F.col("docs"))).select("template", "docs"), "more")
        if not more.limit(1).count():
            return found
        found = written(found.union(more), "recurring")
        few = written(few.join(_small(more, broadcast_rows), "template", "left_anti"), "few")


def _generalised(lines: DataFrame, docs: DataFrame, fields: DataFrame, depth: int, broadcast_rows: int) -> DataFrame:
    """``lines`` with ``template``: the hash of the line, its leaf's variable fields masked."""
    held = _texts(docs, depth).join(_small(fields, broadcast_rows), ["leaf", "size"])
    general = F.transform(F.split("text", " "), lambda t, i: F.when(F.array_contains("fields", i), F.lit(VARIABLE)).otherwise(t))
    named = written(held.select(F.xxhash64("text").alias("line"), F.xxhash64(F.array_join(general, " ")).alias("template")).distinct(), "named")
    return lines.join(_small(named, broadcast_rows), "line", "left").withColumn("template", F.coalesce("template", "line"))


def dropped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """(row, lines): the positions of the dropped lines by the hash of doc_id and text."""
    lines, found = recurring(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), broadcast_rows=broadcast_rows, **options)
    least = options.get("min_tokens", 3)
    hit = lines.where(F.col("size") >= least).join(_small(found.select("template"), broadcast_rows), "template", "left_semi")
    return hit.groupBy("row").agg(F.collect_set("at").alias("lines"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and n_lines and n_dropped."""
    gone = dropped(docs, text, doc_id, **options).withColumnRenamed("row", "_row").withColumnRenamed("lines", "_lines")
    joined = docs.withColumn("_row", F.xxhash64(doc_id, text)).join(gone, "_row", "left")
    split = F.split(text, "\n")
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains("_lines", i)), "\n")
    out = joined.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(split)), "n_dropped": F.coalesce(F.size("_lines"), F.lit(0)).cast("int")})
    out = out.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    return out.withColumn(text, F.when(F.col("_lines").isNull(), F.col(text)).otherwise(kept)).drop("_row", "_lines")
