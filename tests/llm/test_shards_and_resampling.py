import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nymora.llm import queries, resampling, sharding
from nymora.llm.common import written

DOCS = "doc_id long, text string, shard string"


def held(out, rows, shards):
    """Checks what holds for all shards; returns bytes by shard."""
    got = [(r["doc_id"], r["text"]) for r in out]
    assert sorted(map(repr, got)) == sorted(repr(r[:2]) for r in rows)
    by = defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and 0 <= r["n"] < shards
        by[r["n"]].append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    sizes = Counter({s: 0 for s in range(shards)})
    for r in out:
        sizes[r["n"]] += r["size"]
    return sizes


def sharded(df, **options):
    out = sharding.shard(written(df, "docs"), **options)
    return out.toDF(*["n" if i == len(out.columns) - 2 else c for i, c in enumerate(out.columns)]).collect()


@pytest.mark.parametrize("part_bytes", [256 << 20, 3000])
def test_shards_are_near_equal(spark, part_bytes):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 60) + str(rng.random()), "x") for i in range(4000)] + [(None, None, "x"), (5, None, "x"), (5, "", None)] * 3
    out = sharded(spark.createDataFrame(rows, DOCS).repartition(5), shards=8, part_bytes=part_bytes)
    sizes = held(out, rows, 8)
    even = sum(sizes.values()) / 8
    assert all(abs(s - even) <= 0.003 * even + 140 for s in sizes.values())
    # The order is one of all rows: what lies in a shard has greater keys than what lies in the one before, and slots follow the keys.
    laid = [(r["text"] or "") for r in sorted(out, key=lambda r: (r["n"], r["slot"]))]
    last = {t: i for i, t in enumerate(laid)}
    assert all(laid.count(t) == last[t] - laid.index(t) + 1 for t in {"", *rng.sample(laid, 20)})


def test_groups_of_copies(spark):
    rng = random.Random(2)
    many = [(i, f"text {i // 3} " + "y" * 40, "x") for i in range(6000)]  # groups of three stay together
    out = sharded(spark.createDataFrame(many, DOCS), shards=16)
    sizes = held(out, many, 16)
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    by = defaultdict(set)
    for r in out:
        by[r["text"]].add(r["n"])
    assert sum(len(s) > 1 for s in by.values()) == 0
    hot = many + [(10_000 + i, "a copy of a third of all bytes", "x") for i in range(5000)] + [(3, "the same row", "x")] * 3000
    rng.shuffle(hot)
    sizes = held(sharded(spark.createDataFrame(hot, DOCS).repartition(6), shards=16), hot, 16)
    assert max(sizes.values()) < 1.03 * min(sizes.values())


def test_shards_of_odd_tables(spark):
    big = [(1, "x" * 1_000_000, ""), (2, "b", ""), (3, None, ""), (4, "c" * 10, "")]
    sizes = held(sharded(spark.createDataFrame(big, DOCS), shards=4), big, 4)
    assert sorted(sizes.values())[-1] >= 1_000_001
    assert sharding.shard(spark.createDataFrame([], DOCS), shards=4).count() == 0
    one = [(7, "only", "")]
    assert sum(held(sharded(spark.createDataFrame(one, DOCS), shards=16), one, 16).values()) == 5


def test_shard_query_and_files(spark, tables, tmp_path):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    out = queries.op12_sharding(spark, tables).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in out} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for d, t in docs.items()}
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    even, most = sum(sizes.values()) / 16, max(r.size for r in out)
    assert len(out) == len(docs) and all(abs(sizes[s] - even) <= 0.011 * even + most for s in range(16))
    sharding.write_shards(sharding.shard(spark.read.parquet(f"{tables}/documents.parquet"), shards=3), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(docs) and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


# --- resampling ------------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_resample(docs, bench, most=1, buckets=10_000, percent=10, least=20):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for i in range(len(w)) for n in range(1, most + 1) if i + n <= len(w)]

    s, t = (Counter(b for x in texts for b in features(x)) for texts in ((x for _, x in docs), bench))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_equals_brute_force(spark, most):
    rng = random.Random(most)
    docs = [(i, " ".join(rng.choices(["Wort", "hello", "Éa", "x1", "a-b", "9", "ÄÖ", "it's"], k=rng.choice([0, 5, 19, 20, 60])))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (None, "wort " * 30), (7, docs[7][1]), (1002, "wort\x00Hello\x7f " * 20_000)]
    bench = ["hello hello x1", None, "Éa é"]
    out = resampling.resample(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, score int"), spark.createDataFrame([(b,) for b in bench], "text string"), most=most, percent=37)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect()), key=repr)
    assert got == brute_resample(docs, bench, most, percent=37)


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert [(r.n_features, r.rank) for r in resampling.resample(some, none).orderBy("doc_id").collect()] == [(2, None), (0, None)]


def test_words_are_those_of_the_pattern():
    text = "".join(map(chr, [*range(0x250), 0x4E2D, 0x1F600, 0x85, 0xA0, 0x2028]))
    assert [w.decode() for w in resampling.words(text.encode())] == words_of(text)
    assert list(resampling.runs([b"a", b"bc", b"d"], 2)) == [zlib.crc32(x) for x in (b"a", b"a bc", b"bc", b"bc d", b"d")]


def test_ties_go_to_the_smaller_id(spark):
    own = [(r.score, r.doc_id) for r in queries.op13_resampling(spark, "/root/testdata/sf0.001").where(F.col("rank").isNotNull()).orderBy("rank").collect()]
    assert own == sorted(own, key=lambda x: (-x[0], x[1])) and own
