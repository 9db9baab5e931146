import random
import tracemalloc

import numpy as np
import pandas as pd
import xxhash

from nymora.llm import simhash
from nymora.llm.common import connected


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=3):
    """rows: (doc_id, fingerprint); the smallest doc_id reachable of each row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j in range(i):
            if (x ^ rows[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(rows))]


def test_fingerprints_of_odd_texts():
    for text in (None, "", " \n", "One", "a b", "A b C", "x\x0by z  w é Ü", "word " * 500):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_whole_table_matches_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert got == {doc: (fp, c) for (doc, fp), c in zip(rows, brute_components(rows), strict=True)}


def test_cells_and_chunks_lose_no_link(spark):
    rng = random.Random(4)
    points = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(12):
            points.add(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    points = sorted(points)
    signed = [(int(np.uint64(p).astype("int64")),) for p in points]
    want = brute_components(list(enumerate(points)))
    for cell_points in (4, 2048):
        found = connected(simhash.links(simhash._cells(spark.createDataFrame(signed, "fp long")), 3, cell_points)).collect()
        root = {r.node: r.root for r in found}
        groups = {}
        for (s,), w in zip(signed, want, strict=True):
            assert groups.setdefault(w, root.get(s, s)) == root.get(s, s)
        assert len(set(groups.values())) == len(groups)


def brute_similar(rows, size=5, similarity=0.8):
    """rows: (doc_id, text); the smallest doc_id of each group of texts linked by Jaccard similarity."""
    by = {}
    for doc, text in rows:
        w = tuple((text or "").encode().lower().split())
        by[w] = min(by.get(w, doc), doc)
    sets = [({w[i : i + size] for i in range(max(1, len(w) - size + 1))} if w else set(), doc) for w, doc in by.items()]
    held = {}
    for i, (s, _) in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in {(i, j) for own in held.values() for i in own for j in own if i < j}:
        a, b = sets[j[0]][0], sets[j[1]][0]
        if len(a & b) >= similarity * len(a | b):
            root[find(j[0])] = find(j[1])
    least = {}
    for i, (_, doc) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return set(least.values())


def test_similar_texts_of_the_whole_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == brute_similar([tuple(r) for r in docs.collect()])


def test_near_copies_of_one_text(spark):
    """A family whose members are near copies of the first one, but not of each other; small tasks and chunks lose no link."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    first = [word() for _ in range(200)]
    rows = [(0, " ".join(first))]
    for i in range(1, 60):
        own = list(first)
        for at in rng.sample(range(200), 3):
            own[at] = word()
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(word() for _ in range(200))) for i in range(20)]
    want = brute_similar(rows)
    assert want == {0, *range(100, 120)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"cell_points": 8, "task_shingles": 2000, "broadcast_rows": 1}):
        assert {r.doc_id for r in simhash.deduplicated(df, **options).collect()} == want


def test_pairs_of_a_large_block_are_not_held_together():
    """2,000 points with 2 million pairs within the distance, of which few are similar."""
    rng = np.random.default_rng(3)
    fp = np.uint64(1) << rng.integers(0, 64, 2000).astype("uint64")
    shingles = [np.unique(rng.integers(-(2**63), 2**63 - 1, 30)) for _ in fp]
    shingles[7] = shingles[1990]
    zeros = np.zeros(len(fp), "int64")
    tracemalloc.start()
    links = simhash.similar_in(fp, zeros, zeros, shingles, 0.8, 10, 48)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [sorted(x) for x in zip(*links, strict=True)] == [[7, 1990]]
    assert most < 40e6


def test_sets_at_the_similarity_itself_are_linked():
    """Sets of any size around a similarity of 0.8, in tasks of one side and of two; few pairs at once lose no link."""
    rng = np.random.default_rng(5)
    shingles, fp = [], []
    for _ in range(40):
        some = rng.integers(-(2**63), 2**63 - 1, int(rng.integers(1, 400)))
        for cut in (0, 0.1, 0.11, 0.2, 0.21):
            own = some.copy()
            own[: int(cut * len(own))] = rng.integers(-(2**63), 2**63 - 1, int(cut * len(own)))
            shingles.append(np.unique(own))
            fp.append(1 << int(rng.integers(0, 4)))
    shingles += [np.arange(9), np.arange(10), np.arange(8), np.arange(4), np.arange(1, 5), np.arange(5)]
    fp += [1] * 6
    fp, task = np.array(fp, "uint64"), np.zeros(len(fp), "int64")
    whole = [set(x.tolist()) for x in shingles]
    for side in (task, rng.integers(1, 3, len(fp))):
        want = simhash.Sets(len(fp))
        for i in range(len(fp)):
            for j in range(i):
                if (side[i] == 0 or side[i] != side[j]) and len(whole[i] & whole[j]) >= 0.8 * len(whole[i] | whole[j]):
                    want.join(i, j)
        for at_once in (1, 50, 1 << 18):
            got = simhash.Sets(len(fp))
            for x, y in zip(*simhash.similar_in(fp, task, side, shingles, 0.8, 10, 48, at_once), strict=True):
                assert got.join(x, y)
            assert [got.find(i) for i in range(len(fp))] == [want.find(i) for i in range(len(fp))]


def test_rows_of_long_texts_share_fewer_calls(spark):
    """A call's rows are bounded by what they weigh, and a task over several batches isn't cut."""
    rows = spark.createDataFrame([(k, 0, 0, [0] * 100) for k in range(40) for _ in range(3)], "root long, i int, j int, shingles array<long>").coalesce(1)
    done = lambda frame, task: pd.DataFrame({"a": [int(frame["shingles"].map(len).sum())], "b": [int(frame["root"].value_counts().min())]})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        calls = simhash._by_task(rows, "root", done, 600, "a long, b long", lambda frame: int(frame["shingles"].map(len).sum())).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(c.a for c in calls) == 12_000 and {c.b for c in calls} == {3}
    assert max(c.a for c in calls) <= 800


def test_deduplicated_keeps_one_of_each(spark):
    long = "word " * 100_000 + "end"
    rows = [(3, "a b c d", "x"), (1, "A  b c d", "y"), (1, "A  b c d", "y"), (None, "q r s t", "z"), (None, "q r s t", "z"), (5, None, "n"), (4, "", "e"), (9, "quite another text here", "o"), (11, long, "l"), (10, long, "l")]
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _hashed string")).collect()
    want = [(1, "A  b c d", "y"), (None, "q r s t", "z"), (4, "", "e"), (9, "quite another text here", "o"), (10, long, "l")]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert simhash.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
