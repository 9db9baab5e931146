import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from nymora.llm import packing, queries, token_file, topk
from nymora.llm.tokens import Encoder, default_path, encoder
import pyarrow as pa

ODD = [None, "", "  a  b\n\nc é\t", "<|endoftext|> x <|ENDOFTEXT|>", "don't STOP\nnow 12 3 a.b,,c!!! (x). x~y ~ CAFE\u0301. é.", "日本語 text 🔑.", "w" * 200 + " " + "q,w.e" * 50]


TOKENIZER = Tokenizer.from_file(default_path())


def plain_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_kept_pieces_give_the_tokenizers_ids(spark, tables):
    texts = ODD + [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").orderBy("doc_id").collect()]
    tok = Tokenizer.from_file(default_path())
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in encoder(default_path()).each(pa.array(texts))] == want


def test_encoding_holds_little_at_once():
    """12 MB of text in one batch take less than 50 MB of NumPy's and Python's memory beside Arrow's (82 MB in slices of 6 MB); the ids are the same."""
    texts = pa.array([" ".join(f"word{(i * j) % 500}" for j in range(300)) for i in range(5000)])
    encode = encoder(default_path())
    want = [plain_ids(t) for t in texts[:10].to_pylist()]
    assert [x.tolist() for x in encode.each(texts.slice(0, 10))] == want
    tracemalloc.start()
    try:
        n = sum(len(x) for x in encode.each(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 5000 * 300 and peak < 50e6


def test_words_of_letters_go_to_the_model_at_once(monkeypatch):
    """Words, accented ones before punctuation too, miss the costly way through normalizer and offsets; words that recur are learnt once, however many others pass."""
    encode, whole, words = Encoder(default_path(), limit=40), [], []
    by_text, by_word = encode.encode, encode.word
    monkeypatch.setattr(encode, "encode", lambda t, **k: whole.append(t) or by_text(t, **k))
    monkeypatch.setattr(encode, "word", lambda w: words.append(w) or by_word(w))
    texts = [f"Größe, déjà%%% señor. ÿ! word{'abcdefgh'[i % 8]}{'xyz' * (i // 8 + 1)} straße a" for i in range(60)] + ["naïve e\u0301. x÷y ÉTÉ ½ ª"]
    for t in texts:
        assert [x.tolist() for x in encode.each(pa.array([t]))] == [plain_ids(t)]
    assert not [t for t in whole[:-1] if set(t) & set("abcdefghijklmnopqrstuvwxyzößéàñÿ")] and len(encode.kept) + len(encode.older) <= 60
    assert words.count("a") == 1 and len(words) == 66 + 1


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5).round(2)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 5) for i in range(60)]  # ties
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (1000, [1.0, 2.0]), (1001, [3.0, 1.0]), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), shard_rows=32, query_block=3, near_cells=2).collect()
    sampled = topk.top_k(df, df.where("vec_id % 100 = 0"), shard_rows=32, query_block=3, near_cells=1, fit_values=200).collect()
    whole = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = np.floor(1024 * np.array(v)).astype("int64")
    want = []
    for q in whole:
        if q % 100 == 0:
            scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:10]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(map(tuple, sampled)) == sorted(want)


def test_topk_of_large_components(spark):
    rows = [(i, [2.0**21 + i % 7, 2.0**20 * (i % 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 100"), shard_rows=32).collect()
    whole = {i: [int(1024 * x) for x in v] for i, v in rows}
    scored = sorted((-sum(a * b for a, b in zip(whole[100], v, strict=True)), i) for i, v in whole.items() if i != 100)[:10]
    assert sorted(map(tuple, got)) == [(100, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]


def test_cells_without_hope_are_not_visited(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 50
    vectors = np.array([centres[i % 20] + rng.normal(size=8) for i in range(4000)]).round().astype("int64")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<bigint>")
    router = topk.fit_router(df, 200, 8000)
    cell, gap = router.place(list(vectors))
    radii = np.full(cell.max() + 1, -1.0)
    np.maximum.at(radii, cell, gap)
    scores = vectors @ vectors[0]
    kth = np.sort(scores)[-10]
    cells, bounds, _ = router.reach(vectors[0].astype("float64"), radii)
    assert set(cell[scores >= kth]) <= set(cells[bounds >= kth])
    assert (bounds >= kth).sum() < len(cells) / 2


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


def test_first_fit_decreasing_is_what_it_says():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4097, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 4096)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(4096)
        want[i] = (b, 4096 - room[b])
        room[b] -= lengths[i]
    assert [(bins[i], offsets[i]) for i in range(500)] == [want[i] for i in range(500)]


def test_packing_covers_each_id_once(spark):
    rows = list(enumerate(ODD)) + [(50, "word " * 9000), (50, "word " * 9000), (None, "no id")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), docs_per_group=4).collect()
    for doc, text in rows:
        copies = sum(1 for r in rows if r == (doc, text))
        ids = np.array(plain_ids(text), "<u4")
        own = sorted([r for r in out if r.doc_id == doc], key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_blocks_round_trip():
    rng = np.random.default_rng(7)
    for n in (1, 5, 1024, 1025, 150_000, 400_000):
        ids = np.minimum(rng.geometric(0.01, n), 49407).astype("uint32")
        table = token_file.Table(np.bincount(ids))
        block = token_file.encode_block(ids, table)
        assert (token_file.decode_block(block, table) == ids).all()
        marks = token_file.checkpoints(block)
        for i in range(len(marks)):
            begin = marks[i][0] * token_file.LANES
            end = marks[i + 1][0] * token_file.LANES if i + 1 < len(marks) else n
            assert (token_file.decode_block(block, table, i, i + 1) == ids[begin:end]).all()
    broken = bytearray(block)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        token_file.decode_block(bytes(broken), table)


def test_token_file_digest(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text) for r in docs.union(odd).collect())
    got = {r.doc_id: tuple(r)[1:] for r in token_file.round_trip(docs.union(odd)).collect()}
    at = 0
    for doc, text in rows:
        ids = np.array(plain_ids(text), "<u4")
        assert got[doc] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_file.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_file_parts_by_bytes(spark, tmp_path):
    """More text makes more parts; equal rows, of a null id too, are parted like others, and a very long text is one of its own."""
    rows = [(None, "the same words again")] * 300 + [(7, "seven")] * 50 + [(8, "a long text " * 40_000), (9, None), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    parts, digests = {}, {}
    for size in (1 << 30, 1000):
        token_file.write(docs, f"{tmp_path}/{size}", part_bytes=size)
        parts[size] = spark.read.parquet(f"{tmp_path}/{size}/blocks").where("exists(doc_ids, d -> d is null)").select("part").distinct().count()
        digests[size] = sorted(token_file.digest(spark, f"{tmp_path}/{size}").select("start", "doc_id", "n_tokens", "ids_crc32").collect(), key=lambda r: r.start)
    assert parts[1000] > parts[1 << 30]
    want = sorted((d is not None, d or 0, n, c) for d, t in rows for ids in [np.array(plain_ids(t), "<u4")] for n, c in [(len(ids), zlib.crc32(ids.tobytes()))])
    for got in digests.values():
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))


def test_packing_of_a_whole_table(spark, tables):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    docs, sequences = {}, {}
    for r in queries.op6_packing(spark, tables).collect():
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert docs.keys() == texts.keys()
    for doc, own in docs.items():
        ids = np.array(plain_ids(texts[doc]), "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):  # each id in one piece
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    used = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
        used += at
    assert used >= 0.9 * 4096 * (len(sequences) - 1)
