"""Known names from a table: an Aho-Corasick automaton in every task for as many as fit, equality joins of folded windows for more.

Both give whole words whatever their case, longest first, then leftmost, disjoint.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scan import KnownNames, fold_case, longest_names, whole_words
from .detect import ARROW
from .spans import ENTITIES
from .tables import stored
from .windows import nominator


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fold_case(t) for t in texts.to_pylist()], pa.string())


def _entity(text: str, kind: str, start: int, end: int) -> dict:
    return {"type": kind, "value": text[start:end], "start": start, "end": end, "detector": "known_entities", "confidence": 1.0}


def known_names(df: DataFrame, names: DataFrame, text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """``df`` with ``entities``. names: name, type (PERSON, ORG or LOCATION); blank names are left out.

    Up to ``broadcast_rows`` names, counted, are broadcast; the automaton reads a text once, however many names it holds. Beyond, windows of the folded texts
    that begin and end at a word's edge and pass a bit map of the names are joined with them.
    """
    own = names.select("name", "type").where(F.trim("name") != "").distinct()
    if own.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by: dict[str, list[str]] = {"PERSON": [], "ORG": [], "LOCATION": []}
        for name, kind in sorted(map(tuple, own.collect())):
            by[kind].append(name)
        shared, made = df.sparkSession.sparkContext.broadcast(by), []

        @F.arrow_udf(ENTITIES)
        def find(texts: pa.Array) -> pa.Array:
            if not made:
                made.append(KnownNames(shared.value["PERSON"], shared.value["ORG"], shared.value["LOCATION"]))
            return pa.array([[_entity(t, h.type, h.start, h.end) for h in made[0].find(t)] if t else [] for t in texts.to_pylist()], ARROW)

        return df.withColumn("entities", find(F.col(text)))
    # Of one spelling under several types the first type in this order counts, as it does in the automaton.
    order = F.when(F.col("type") == "PERSON", 0).when(F.col("type") == "ORG", 1).otherwise(2)
    table = stored(own.withColumn("piece", _folded("name")).groupBy("piece").agg(F.min_by("type", order).alias("type")))
    rows = stored(df.withColumn("_n", F.monotonically_increasing_id()))
    shared_map = df.sparkSession.sparkContext.broadcast(nominator(table, "piece"))

    @F.arrow_udf("array<struct<start:int,end:int,piece:string>>")
    def look(texts: pa.Array) -> pa.Array:
        low = [fold_case(t or "") for t in texts.to_pylist()]
        out = [[] for _ in low]
        for i, a, b in shared_map.value.find_all(low):
            if whole_words(low[i], a, b):
                out[i].append({"start": a, "end": b, "piece": low[i][a:b]})
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])))

    @F.arrow_udf(ENTITIES)
    def chosen(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, own_ in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
            kept = longest_names([(h["start"], h["end"], h["type"]) for h in own_ or ()])
            out.append([_entity(t, kind, a, b) for a, b, kind in kept])
        return pa.array(out, ARROW)

    seen = rows.select("_n", F.explode(look(F.col(text))).alias("h")).select("_n", "h.*")
    hit = seen.join(table, "piece").groupBy("_n").agg(F.collect_list(F.struct("start", "end", "type")).alias("_hits"))
    joined = rows.join(hit, "_n", "left")
    some = F.col("_hits").isNotNull()
    return joined.withColumn("entities", F.coalesce(F.when(some, chosen(F.when(some, F.col(text)), F.col("_hits"))), F.array().cast(ENTITIES))).drop("_n", "_hits")
