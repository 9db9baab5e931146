"""Token ids of whole texts by a public tokenizer file.

Pieces between spaces and line feeds are encoded once per worker and kept: the tokenizer normalises and splits at white
space, so the ids of a text are those of its pieces in order (tests compare both ways). The kept pieces are bounded.
Columns are split and numbered, and ids are gathered, by Arrow, so no Python code runs for each word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 2
_loaded: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(texts: pa.Array, most_bytes: int = 3 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a string column, each of about ``most_bytes`` at most or one row.

    What is made of a slice takes ten times its bytes and more, in each of an executor's workers at once. Workers live on from task to
    task, so what Arrow's pool still holds of past slices is given back at the end.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64"))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
        yield at, texts.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


class Encoder:
    """``limit`` bounds the pieces that are kept; when half of it is full, those not met since the last time are dropped."""

    #: Punctuation that is cut from the end of a piece when one of LETTERS stands before it; a tokenizer boundary lies there anyway.
    TAIL = ".,!&#$%*"
    #: Letters that the tokenizer's normalizer leaves as they are. A piece of them alone is one word to it.
    LETTERS = "a-zß-öø-ÿ"
    #: Stands between other pieces that are encoded together; pieces that hold it are encoded alone.
    MARK = "~"

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.word = tokenizer.encode, tokenizer.model.tokenize
        # The model takes words in the pre-tokenizer's alphabet of bytes.
        self.alphabet = {c: tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
        (self.mark,) = self.encode(self.MARK, add_special_tokens=False).ids
        self.plain = re.compile(f"[{self.LETTERS}]+").fullmatch
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit

    def _alone(self, piece: str) -> bytes:
        return np.array(self.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of new pieces, 4 bytes each. Words of LETTERS go to the tokenizer's model at once; others are encoded together and told apart by MARK's id."""
        out: dict[str, bytes] = {}
        words = [p for p in pieces if self.plain(p)]
        for i in range(0, len(words), 4000):
            some = words[i : i + 4000]
            ids = [[t.id for t in self.word(w)] for w in "\n".join(some).translate(self.alphabet).split("\n")]
            self._cut(some, np.array([x for w in ids for x in w], "<u4"), np.cumsum([len(w) for w in ids]), out)
        rest = [p for p in pieces if p not in out]
        out |= {p: self._alone(p) for p in rest if self.MARK in p or "<|" in p}
        rest = [p for p in rest if p not in out]
        for i in range(0, len(rest), 4000):
            some = rest[i : i + 4000]
            ids = np.array(self.encode(f" {self.MARK} ".join([*some, ""]), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(some):
                out |= {p: self._alone(p) for p in some}
                continue
            self._cut(some, np.delete(ids, ends), ends - np.arange(len(ends)), out)
        return out

    @staticmethod
    def _cut(pieces: list[str], ids: np.ndarray, ends: np.ndarray, out: dict[str, bytes]) -> None:
        flat, at = ids.tobytes(), 0
        for p, end in zip(pieces, (4 * ends).tolist(), strict=True):
            out[p] = flat[at:end]
            at = end

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.kept.get, pieces))
        missed = [p for p, x in zip(pieces, found, strict=True) if x is None]
        if not missed:
            return found
        learnt = {p: self.older[p] for p in missed if p in self.older}
        learnt |= self._learn([p for p in missed if p not in learnt])
        if len(self.kept) + len(learnt) > self.limit // 2:
            self.older, self.kept = self.kept, {}
        self.kept.update({p: x for p, x in learnt.items() if len(p) <= 64})
        return [learnt[p] if x is None else x for p, x in zip(pieces, found, strict=True)]

    def _ids(self, pieces: pa.DictionaryArray) -> pa.Array:
        """The ids of each piece, as bytes."""
        return pa.array(self._lookup(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after the other, each with END, and where each text's ids end. Null is empty."""
        # The replacement also makes arrays of their own from slices, which ascii_lower doesn't read rightly.
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        special = pc.match_substring(texts, "<|")
        lower = pc.ascii_lower(texts)
        words = pc.split_pattern(pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower, " ")
        offsets = words.offsets.to_numpy().astype("int64")
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        whole = coded.dictionary
        core = pc.utf8_rtrim(whole, self.TAIL)
        cut = pc.and_(pc.less(pc.binary_length(core), pc.binary_length(whole)), pc.match_substring_regex(core, f"[{self.LETTERS}]$"))
        core = pc.if_else(cut, core, whole).dictionary_encode()
        tail = pc.replace_substring_regex(pc.if_else(cut, whole, ""), f"^(?s:.*)[^{self.TAIL}]", "").dictionary_encode()
        each = pc.binary_join_element_wise(self._ids(core), self._ids(tail), pa.scalar(b"", pa.large_binary()))
        each = pa.concat_arrays([each, pa.array([np.array([END], "<u4").tobytes()], pa.large_binary())])
        last = offsets[1:] - offsets[0]
        out = each.take(pa.array(np.insert(coded.indices.to_numpy(), last, len(whole))))
        _, starts, data = out.buffers()
        ends = np.frombuffer(starts, "int64")[1 : len(out) + 1] // 4
        return np.frombuffer(data, "<u4")[: int(ends[-1])] if len(ends) else np.zeros(0, "<u4"), ends[last + np.arange(len(last))]

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        for _, part in slices(texts):
            ids, ends = self.column(part)
            yield from np.split(ids, ends[:-1])


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file, loaded once."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
