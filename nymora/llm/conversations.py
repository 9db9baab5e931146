"""Repair of the structure of conversations: blank and repeated turns go, roles come to follow ``(system? (user assistant)+)?``, at the least cost.

Turns are range-sorted by conversation and turn once. Where a conversation lies inside of one partition, its turns become a sequence of roles and faults; many
such sequences share one Re-Pair grammar with a transfer matrix a rule (``grammar``), which gives their costs and edits. A conversation that
reaches over a partition's edge, or is longer than ``piece_rows`` turns or ``piece_bytes``, is cut into pieces: each piece gets its own matrix with all of
its audits, the matrices of a conversation are multiplied in order (one small row a piece), and the pieces are rewritten with the states found. So
no task holds more than a piece of a long conversation; only its SHA-256, which is sequential by definition, is fed by one task, in order,
a piece at a time, and its audit is one cell.

Defined cases: nulls count as one space, a null conv_id as a conversation of its own; turns go by number, nulls first, equal ones by role, text's
hash and place in the table; equal rows are repeats; an empty role can't be kept, nor can one whose initial isn't s, u or a; a conversation
without turns has zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .grammar import CLOSING, STATES, Grammar, alone, applied, cheapest

BLANKS = " \t\n\v\f\r"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: What a sequential reader keeps of a piece, for its neighbours: initials at its edges, numbers of its turns.
EDGES = "first string, last string, least_turn long, most_turn long, turns long, first_turn long, last_turn long"
PIECE = f"piece long, conv_id {{0}}, {EDGES}, illegal long, sequence string, keys array<struct<key:binary,at:int>>, roles array<string>, texts array<string>, done struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string,repaired_sha256:string>"


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with one fault in four rows: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", blank)
    hit = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"), F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fault.alias("_f"))
    return hit.where("_f <> 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_f") == 3, 2).otherwise(1)))).drop("_f", "_copy")


class Reader:
    """Turns of one conversation, in order."""

    def __init__(self, conv):
        self.conv, self.roles, self.texts, self.sequence, self.keys, self.size, self.illegal = conv, [], [], [], {}, 0, 0
        self.first = self.last = ""
        self.numbers: list[int] = []  # first, last, distinct
        self.counts = [0, 0, 0]

    def add(self, turn: int | None, role: str, text: str) -> None:
        own = text.rstrip(BLANKS)
        initial = role[:1]
        if self.roles:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        if turn is not None:
            if not self.numbers:
                self.numbers = [turn, turn, 1]
            elif turn != self.numbers[1]:
                self.numbers[1:] = [turn, self.numbers[2] + 1]
        if not own:
            code = "b"
        else:
            key = hashlib.blake2b(f"{len(role)} {role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key in self.keys:
                code = "d"
            else:
                self.keys[key] = len(self.roles)
                code = initial if initial in ("s", "u", "a") else "o"
                code = code if own[-1] in ".!?" else code.upper()
        self.sequence.append(code)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text) + 50


def faults(sequence: str) -> tuple[int, int, int]:
    """(blank, repeated, truncated)"""
    return sequence.count("b"), sequence.count("d"), sum(map(sequence.count, "SUAO"))


def terminals(sequence: str) -> str:
    return sequence.replace("b", "x").replace("d", "x")


def _finished(readers: list[Reader]) -> list[dict]:
    """The results of whole conversations, by one grammar."""
    own = [terminals("".join(r.sequence)) for r in readers]
    grammar = Grammar(own)
    cost, to = alone(*grammar.matrices(own))
    audits = grammar.audits([(s, 0, t) for s, t in zip(own, to.tolist(), strict=True)])
    out = []
    for r, c, t, audit in zip(readers, cost.tolist(), to.tolist(), audits, strict=True):
        audit += CLOSING[t]
        repaired = "\n".join(applied(list(zip(r.roles, r.texts, strict=True)), audit))
        gaps = r.numbers[1] - r.numbers[0] + 1 - r.numbers[2] if r.numbers else 0
        blank, duplicate, truncated = faults("".join(r.sequence))
        out.append({"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": r.illegal, "cost": c, "audit": audit, "repaired_sha256": hashlib.sha256(repaired.encode("utf-8", "surrogatepass")).hexdigest()})
    return out


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, piece_rows: int, piece_bytes: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to finished conversations and to pieces of those that reach over an edge."""
    base = TaskContext.get().partitionId() << 32
    number, held, whole, size = 0, None, [], 0
    edge = True  # does the reader hold the partition's first conversation, or a part of a cut one?

    def given(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def piece(r: Reader) -> dict:
        nonlocal number
        number += 1
        first, last, turns = r.numbers or (None, None, 0)
        return {"piece": base + number, "conv_id": r.conv, "first": r.first, "last": r.last, "least_turn": first, "most_turn": last, "turns": turns, "first_turn": first, "last_turn": last, "illegal": r.illegal, "sequence": "".join(r.sequence), "keys": [{"key": k, "at": i} for k, i in r.keys.items()], "roles": r.roles, "texts": r.texts}

    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held is not None and held.conv != conv:
                if edge:
                    yield given([piece(held)])
                else:
                    whole.append(held)
                    size += held.size
                held, edge = None, False
            elif held is not None and (len(held.roles) >= piece_rows or held.size >= piece_bytes):
                yield given([piece(held)])
                held, edge = None, True
            if size >= block_bytes:
                yield given([{"conv_id": r.conv, "done": d} for r, d in zip(whole, _finished(whole), strict=True)])
                whole, size = [], 0
            if held is None:
                held = Reader(conv)
            held.add(turn, role, text)
    if held is not None:
        yield given([piece(held)])
    if whole:
        yield given([{"conv_id": r.conv, "done": d} for r, d in zip(whole, _finished(whole), strict=True)])


def _arrow(schema: str, spark) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return schema, to_arrow_schema(StructType.fromDDL(schema))


def _matrices(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces with the turns that repeat one of an earlier piece -> their matrices and all of their audits."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            own = list(r["sequence"])
            for at in r.pop("late") or ():
                own[at] = "d"
            r["sequence"] = "".join(own)
        own = [terminals(r["sequence"]) for r in rows]
        grammar = Grammar(own)
        costs, ranks = grammar.matrices(own)
        ways = [(i, j) for i in range(STATES) for j in range(STATES)]
        asked = [(n, i, j) for n in range(len(rows)) for i, j in ways if costs[n, i, j] < 1 << 40]
        said = dict(zip(asked, grammar.audits([(own[n], i, j) for n, i, j in asked]), strict=True))
        for n, r in enumerate(rows):
            r["blank"], r["duplicate"], r["truncated"] = faults(r.pop("sequence"))
            r["costs"], r["ranks"] = costs[n].ravel().tolist(), ranks[n].ravel().tolist()
            r["audits"] = [said.get((n, i, j)) for i, j in ways]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


WAY = "struct<cost:long,gaps:long,illegal:long,ways:array<struct<piece:long,start:int,end:int,closing:string>>>"


def _ways(pieces: pa.Array) -> pa.Array:
    """The pieces of a conversation, in order -> the states at their edges, and what is counted across edges."""
    import numpy as np

    out = []
    for own in pieces.to_pylist():
        cost, states = cheapest(np.array([p["costs"] for p in own], "int64").reshape(-1, STATES, STATES), np.array([p["ranks"] for p in own], "int64").reshape(-1, STATES, STATES))
        illegal, distinct, before, least, most = sum(p["illegal"] for p in own), 0, None, None, None
        for a, b in zip(own, own[1:], strict=False):
            illegal += a["last"] + b["first"] not in ("su", "ua", "au")
        for p in own:
            if p["turns"]:
                distinct += p["turns"] - (before == p["first_turn"])
                before, most = p["last_turn"], p["most_turn"]
                least = p["least_turn"] if least is None else least
        gaps = most - least + 1 - distinct if distinct else 0
        ways = [{"piece": p["piece"], "start": s, "end": t, "closing": ""} for p, s, t in zip(own, states, states[1:], strict=False)]
        ways[-1]["closing"] = CLOSING[states[-1]]
        out.append({"cost": cost, "gaps": gaps, "illegal": illegal, "ways": ways})
    turns = pa.struct([("piece", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("closing", pa.string())])
    return pa.array(out, pa.struct([("cost", pa.int64()), ("gaps", pa.int64()), ("illegal", pa.int64()), ("ways", pa.list_(turns))]))


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces with their audits, by conversation and in order -> the SHA-256 of each conversation's repaired turns."""
    nothing = object()
    conv, digest, some = nothing, None, False

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema=schema)

    for batch in batches:
        for own, audit, state, roles, texts in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "start", "roles", "texts")), strict=True):
            if conv is nothing or own != conv:
                if conv is not nothing:
                    yield ended()
                conv, digest, some = own, hashlib.sha256(), False
            if lines := applied(list(zip(roles, texts, strict=True)), audit, state):
                digest.update(("\n" * some + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                some = True
    if conv is not nothing:
        yield ended()


def _joined_pieces(read: DataFrame, of: str) -> DataFrame:
    """RESULT of the conversations that came in pieces."""
    spark = read.sparkSession
    parts = read.where("done is null")
    keys = parts.select("piece", "conv_id", F.explode("keys").alias("k")).select("piece", "conv_id", "k.key", "k.at")
    first = keys.groupBy("conv_id", "key").agg(F.min("piece").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = F.col("k.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("k.key") == F.col("f.key"))
    late = keys.alias("k").join(first.alias("f"), same).where("piece > _first").groupBy("piece").agg(F.collect_list("at").alias("late"))
    edges = ["piece", "conv_id", *(x.split()[0] for x in EDGES.split(", ")), "illegal"]
    ddl, arrow = _arrow(f"piece long, conv_id {of}, {EDGES}, illegal long, blank long, duplicate long, truncated long, costs array<long>, ranks array<long>, audits array<string>", spark)
    marked = parts.select(*edges, "sequence").join(late, "piece", "left")
    solved = written(marked.mapInArrow(lambda b: _matrices(b, arrow), ddl), "matrices")
    small = F.struct(*edges[:1], *edges[2:], "costs", "ranks")
    sums = [F.sum(c).alias(c) for c in COUNTS[:3]]
    way = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(small)).alias("_p"), *sums).withColumn("w", F.arrow_udf(_ways, WAY)("_p")).drop("_p")
    ways = written(way, "ways")
    each = ways.select(F.explode("w.ways").alias("x")).select("x.*")
    said = F.element_at("audits", F.col("start") * STATES + F.col("end") + 1)
    told = written(solved.join(each, "piece").select("piece", "conv_id", "start", F.concat(said, "closing").alias("audit")), "audits")
    audits = told.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    hash_ddl, hash_arrow = _arrow(f"conv_id {of}, repaired_sha256 string", spark)
    text = told.drop("conv_id").join(parts.select("piece", "conv_id", "roles", "texts"), "piece")
    hashes = text.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(lambda b: _hashed(b, hash_arrow), hash_ddl)
    totals = ways.select("conv_id", "w.gaps", *COUNTS[:3], "w.illegal", "w.cost")
    out = totals
    for more in (audits, hashes):
        out = out.alias("a").join(more.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return out


def repaired(turns: DataFrame, conversations: DataFrame | None = None, piece_rows: int = 4096, piece_bytes: int = 1 << 18, block_bytes: int = 16 << 20) -> DataFrame:
    """RESULT for each conversation of ``turns`` (conv_id, turn, role, text) and each conv_id of ``conversations``."""
    of = dict(turns.dtypes)["conv_id"]
    ddl, arrow = _arrow(PIECE.format(of), turns.sparkSession)
    blank = F.lit(" ")
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_i"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "_h", "_i"]
    laid = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    read = written(laid.mapInArrow(lambda b: _pieces(b, arrow, piece_rows, piece_bytes, block_bytes), ddl), "pieces")
    out = read.where("done is not null").select("conv_id", "done.*").unionByName(_joined_pieces(read, of))
    if conversations is None:
        return out
    ids = conversations.select(F.col("conv_id").alias("_c")).distinct()
    all_ = ids.join(out, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS)]
    return all_.select(F.col("_c").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
