"""Toxicity by noisy-channel deobfuscation.

A document's tokens are decoded before they are judged. A token whose spelling may have been disguised (leetspeak digits and
signs, letters repeated three times or more, letters parted by signs, or letters written apart) becomes a lattice: every character
with its possible readings, every repetition as one or two letters, signs between letters as nothing or as the end of a word; letters
in a row are joined, and after each a word may end. Viterbi's algorithm finds the reading that a character language model of order
``ORDER`` finds likeliest, with a cost for each change, over all states and for tokens and runs of signs of any length. Other tokens have one
reading, themselves in lower case.

The language model counts character sequences over the words of all documents. Its alphabet is what the channel can restore: the
letters a to z (with or without accents), one class for every other letter, and the edge of a word, so the counts fill a table of
``CLASSES ** ORDER`` numbers at most, however large the corpus is. The classifier is a logistic regression on the presence of
restored words and word beginnings. Its features are those that go with the label beyond chance (G-squared counted over all labelled
training rows, its threshold growing with the number of candidates); its weights are fitted on about ``train_rows`` labelled rows,
drawn by hash, and features that none of them has get no weight.

Defined cases: a null or empty text has no words and scores the base rate; rows without a label, or with a null one, aren't learnt
from; several labels of one doc_id count each; without any training row of both classes all scores are 0; repeated rows are scored
each; an empty table gives no rows; columns of the input named like the results are replaced; equally cheap readings: the first found.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import slices

ORDER, EDGE = 4, "^"
#: Edge, a to z, any other letter.
CLASSES = 28
STATES = CLASSES ** (ORDER - 1)
#: Readings of characters that stand for letters.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
MARKS = "".join(READINGS)
#: A word of one letter costs LONE more: letters written apart would else stay what they are.
CHANGE, SKIP, BREAK, LONE = 1.5, 0.5, 1.5, 4.0
#: More states than MANY are advanced as arrays; every SETTLE places, what led to all states alike is settled.
MANY, SETTLE = 64, 256
TOKEN = re.compile(r"\S+")

DISGUISED = re.compile(rf"(?=.*[^\W\d_])(?:.*[{re.escape(MARKS)}]|.*([^\W\d_])\1\1|.*[^\W\d_][-._*'][^\W\d_])", re.S)
PLAIN = re.compile(r"[^\W\d_]+")
#: What is cut from the ends of a token; without marks, a word is left of most tokens.
SIGNS = ".,;:?\")[]{}>#%&*_-~/'"
THRICE = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
#: Tokens that stand for one letter each may be a word written apart.
APART = 4


def letter_class(c: str) -> int:
    base = unicodedata.normalize("NFKD", c)[:1].lower()
    return ord(base) - 96 if "a" <= base <= "z" else CLASSES - 1


#: Classes of the first code points; all others are other letters. EDGE stands between words, which hold letters only.
_classes = np.array([0 if chr(i) == EDGE else letter_class(chr(i)) for i in range(0x250)] + [CLASSES - 1], "int64")


class LetterModel:
    """Costs (negative log-probabilities) of a class of letters after the ORDER - 1 before it, backing off to shorter contexts."""

    def __init__(self, counts: np.ndarray):
        """counts: of each sequence of ORDER classes, as numbers to the base CLASSES."""
        self.counts = np.asarray(counts, "int64")
        self._cost: list[float] | None = None
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {"counts": self.counts, "_cost": None, "_table": None}

    @property
    def table(self) -> np.ndarray:
        """``cost`` as an array."""
        if self._table is None:
            self._table = np.array(self.cost)
        return self._table

    @property
    def cost(self) -> list[float]:
        if self._cost is None:
            full = self.counts.reshape((CLASSES,) * ORDER).astype("float64")
            p, weight = np.full(full.shape, 1e-4), np.ones(full.shape)
            for k in range(ORDER, 0, -1):
                own = full.sum(axis=tuple(range(ORDER - k)), keepdims=True)
                seen = own.sum(axis=-1, keepdims=True)
                share = seen / (seen + 5.0)
                p = p + weight * share * own / np.maximum(seen, 1)
                weight = weight * (1 - share)
            self._cost = (-np.log(np.minimum(p, 1.0))).ravel().tolist()
        return self._cost


def lattice(token: str, apart: bool = False) -> list[list[tuple[str, float]]]:
    """For each place its (reading, cost) pairs; a reading is no, one or two letters, and a space where a word ends. ``apart``: a word may end after any letter."""
    spots = []
    at = 0
    while at < len(token):
        end = at
        while end < len(token) and token[end] == token[at]:
            end += 1
        spots.append((token[at], end - at))
        at = end
    out = []
    for c, run in spots:
        options: dict[str, float] = {}
        if c.isalpha():
            if run == 1:
                options[c] = 0.0
            else:
                options = {c: CHANGE, c * 2: 0.0 if run == 2 else CHANGE}
        else:
            for letter in READINGS.get(c, ""):
                options[letter] = CHANGE
                if run > 1:
                    options[letter * 2] = CHANGE
            options[""] = SKIP if c in "-._*'" else 2 * CHANGE * min(run, 3)
            options[" "] = options[""] + BREAK
        if apart:
            options |= {x + " ": cost + BREAK for x, cost in options.items() if x and x[-1] != " "}
        out.append(list(options.items()))
    return out


def viterbi(places: list[list[tuple[str, float]]], model: LetterModel) -> str:
    """The cheapest reading; the state is the last ORDER - 1 letters. A word's end is judged as well.

    Where all states were reached from one, what led to it is settled, so long tokens need little memory.
    """
    coded: dict[str, list[int]] = {}
    settled: list[str] = []
    state: dict[int, float] = {0: 0.0}
    trail: list[dict[int, tuple[int, str]]] = []

    def back(at: int, steps: list[dict[int, tuple[int, str]]]) -> list[str]:
        out = []
        for step in reversed(steps):
            at, letters = step[at]
            out.append(letters)
        return out[::-1]

    for options in places:
        for letters, _ in options:
            if letters not in coded:
                coded[letters] = [0 if c == " " else letter_class(c) for c in letters]
        state, came = (_advanced_many if len(state) > MANY else _advanced)(state, options, coded, model)
        trail.append(came)
        if len(state) == 1 or len(trail) % SETTLE == 0:
            alive, known = set(state), len(trail)
            while len(alive) > 1:
                known -= 1
                alive = {trail[known][at][0] for at in alive}
            settled += back(alive.pop(), trail[:known])
            del trail[:known]
    cost = model.cost
    last = min(state, key=lambda s: state[s] + (cost[s * CLASSES] + (LONE if s < CLASSES else 0.0) if s else 0.0))
    return "".join([*settled, *back(last, trail)])


def _advanced(state: dict[int, float], options: list[tuple[str, float]], coded: dict[str, list[int]], model: LetterModel) -> tuple[dict[int, float], dict[int, tuple[int, str]]]:
    """The states after one place with their costs, and from which state and by which letters each was reached."""
    cost = model.cost
    step: dict[int, float] = {}
    came: dict[int, tuple[int, str]] = {}
    for letters, price in options:
        codes = coded[letters]
        for past, total in state.items():
            total, now = total + price, past
            for c in codes:
                if c == 0:
                    if now == 0:  # no word to end
                        break
                    total, now = total + cost[now * CLASSES] + (LONE if now < CLASSES else 0.0), 0
                else:
                    total += cost[now * CLASSES + c]
                    now = (now * CLASSES + c) % STATES
            if total < step.get(now, math.inf):
                step[now], came[now] = total, (past, letters)
    return step, came


def _advanced_many(state: dict[int, float], options: list[tuple[str, float]], coded: dict[str, list[int]], model: LetterModel) -> tuple[dict[int, float], dict[int, tuple[int, str]]]:
    """``_advanced`` for all states at once: runs of signs, each of which may be one of several letters, have thousands."""
    table = model.table
    past, so_far = np.fromiter(state, "int64", len(state)), np.fromiter(state.values(), "float64", len(state))
    nows, totals = [], []
    for letters, price in options:
        now, total = past, so_far + price
        for c in coded[letters]:
            if c == 0:
                total = np.where(now == 0, total, total + table[now * CLASSES] + np.where(now < CLASSES, LONE, 0.0))
                now = np.zeros_like(now)
            else:
                key = now * CLASSES + c
                total, now = total + table[key], key % STATES
        nows.append(now)
        totals.append(total)
    now, total = np.concatenate(nows), np.concatenate(totals)
    least = np.full(STATES, math.inf)
    np.minimum.at(least, now, total)
    hits = np.flatnonzero(total == least[now])[::-1]
    first = np.full(STATES, -1)
    first[now[hits]] = hits  # the last to be set, the first of equal ones, stays
    some = np.flatnonzero(first >= 0)
    option, source = np.divmod(first[some], len(past))
    reached = some.tolist()
    came = dict(zip(reached, zip(past[source].tolist(), (options[i][0] for i in option.tolist()), strict=True), strict=True))
    return dict(zip(reached, least[some].tolist(), strict=True)), came


class Restorer:
    """Words of tokens and texts after decoding; what was decoded is kept, ``limit`` tokens of up to ``LONGEST_KEPT`` characters at most."""

    LONGEST_KEPT = 64

    def __init__(self, model: LetterModel, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.kept: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        found = self.kept.get(token)
        if found is None:
            found = self._token(token)
            if len(token) <= self.LONGEST_KEPT:
                if len(self.kept) >= self.limit:
                    self.kept.clear()
                self.kept[token] = found
        return found

    def _token(self, token: str) -> tuple[str, ...]:
        lower = token.lower()
        plain = PLAIN.findall(lower)
        if not DISGUISED.match(lower):
            return tuple(dict.fromkeys(plain))
        core = lower.strip(SIGNS + "(<")
        out: list[str] = []
        for form in dict.fromkeys((core, core.rstrip("!$|+"), core.strip("!$|+0123456789"))):
            if any(c.isalpha() for c in form):
                out += viterbi(lattice(form), self.model).split()
        return tuple(dict.fromkeys([*plain, *out]))

    def apart(self, letters: str) -> list[str]:
        """The words of letters that were written apart."""
        letters = letters.lower()
        return viterbi(lattice(letters, True), self.model).split() if any(c.isalpha() for c in letters) else []

    def words(self, text: str | None) -> set[str]:
        """The restored words of a text, each once; letters written apart are decoded together as well."""
        tokens = TOKEN.findall(text or "")
        out = {w for t in set(tokens) for w in self.token(t)}
        run = ""
        for t in [*tokens, "end"]:
            if _single(t):
                run += t[0]
                continue
            if len(run) >= APART:
                out.update(self.apart(run))
            run = ""
        return out


def _single(token: str) -> bool:
    return len(token) == 1 or len(token) == 2 and not token[1].isalnum()


_made: list[tuple[LetterModel, Restorer]] = []


def restorer(model: LetterModel) -> Restorer:
    """The worker's restorer for this model; it outlives tasks, as Python workers do."""
    if not _made or _made[0][0] is not model:
        _made[:] = [(model, Restorer(model))]
    return _made[0][1]


def features(words: set[str]) -> set[str]:
    """Words, and the first five letters of longer ones."""
    return words | {w[:5] + "-" for w in words if len(w) > 5}


def letter_model(docs: DataFrame, text: str = "text") -> LetterModel:
    """Counts of ORDER letter classes over the words of all texts. At most CLASSES ** ORDER numbers reach the driver."""

    def count(batches):
        total = np.zeros(CLASSES**ORDER, "int64")
        for batch in batches:
            for _, part in slices(batch.column(0)):
                total += gram_counts(part)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("int32")), pa.array(total[some])], ["gram", "n"])

    counts = np.zeros(CLASSES**ORDER, "int64")
    for gram, n in docs.select(text).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n")).toLocalIterator():
        counts[gram] = n
    return LetterModel(counts)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of the ORDER classes that end at each letter or the end of a word; words begin after ORDER - 1 edges."""
    tokens = pc.value_counts(pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))).flatten())
    words = pc.split_pattern(pc.replace_substring_regex(tokens.field(0), r"\PL+", " "), " ")
    ends = words.offsets.to_numpy()
    weights = np.repeat(tokens.field(1).to_numpy(), np.diff(ends))
    words = words.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    full = pc.greater(pc.binary_length(words), 0)
    words, weights = words.filter(full), weights[full.to_numpy(zero_copy_only=False)]
    pad = EDGE * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(words.to_pylist()) + pad).encode("utf-32-le"), "<u4")
    codes = _classes[np.minimum(codes, len(_classes) - 1)]
    edge = codes == 0
    last = np.flatnonzero(~edge[ORDER - 1 :] | ~edge[ORDER - 2 : -1]) + ORDER - 1
    word = np.cumsum(edge[1:] & ~edge[:-1])[last - 1] - edge[last]
    keys = np.zeros(len(last), "int64")
    for back in range(ORDER - 1, -1, -1):
        keys = keys * CLASSES + codes[last - back]
    return np.bincount(keys, weights[word] if len(weights) else None, CLASSES**ORDER).astype("int64")


def token_features(tokens: pa.Array, restore: Restorer) -> tuple[np.ndarray, pa.Array]:
    """(number of the token, feature) pairs of distinct tokens. Tokens that are a word between signs, the most, are read by Arrow."""
    core = pc.utf8_trim(pc.utf8_lower(tokens), SIGNS)
    simple = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring_regex(core, THRICE)))
    simple = pc.and_(simple, pc.string_is_ascii(core)).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(simple)
    words = core.take(pa.array(own))
    long = np.flatnonzero(pc.greater(pc.binary_length(words), 5).to_numpy(zero_copy_only=False))
    heads = pc.utf8_replace_slice(words.take(pa.array(long)), 5, 1 << 30, "-")
    number, rest = [], []
    others = np.flatnonzero(~simple)
    for i, t in zip(others.tolist(), tokens.take(pa.array(others)).to_pylist(), strict=True):
        found = features(set(restore.token(t)))
        number += [i] * len(found)
        rest += found
    found = [x.cast(pa.large_string()) for x in (words, heads, pa.array(rest, pa.large_string()))]
    return np.concatenate([own, own[long], np.array(number, "int64")]), pa.concat_arrays(found)


def _each_once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def present(texts: pa.Array, restore: Restorer, names: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, feature number, names): the features of each row, each once; only those in ``names``, if given, or else all."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    tokens = pc.utf8_split_whitespace(texts)
    ends = tokens.offsets.to_numpy()
    coded = tokens.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
    distinct, codes, begins = coded.dictionary, coded.indices.to_numpy().astype("int64"), ends[:-1] - ends[0]
    token, found = token_features(distinct, restore)
    rows, extra = _apart(distinct, codes, begins, restore)
    # Words of letters written apart stand for themselves: each is a token of its own beyond the distinct ones.
    token = np.concatenate([token, np.arange(len(extra)) + len(distinct)])
    found = pa.concat_arrays([found, pa.array(extra, pa.large_string())])
    if names is None:
        made = found.dictionary_encode()
        number, names = made.indices.to_numpy().astype("int64"), made.dictionary
    else:
        number = pc.fill_null(pc.index_in(found, value_set=names), -1).to_numpy().astype("int64")
        token, number = token[number >= 0], number[number >= 0]
    order = np.argsort(token, kind="stable")
    token, number = token[order], number[order]
    count = np.bincount(token, minlength=len(distinct) + len(extra))
    first = np.cumsum(count) - count
    places = np.flatnonzero(count[codes]) if len(codes) else np.zeros(0, "int64")
    row = np.concatenate([np.searchsorted(begins, places, "right") - 1, rows])
    code = np.concatenate([codes[places], np.arange(len(extra)) + len(distinct)])
    pairs = _each_once(row * len(count) + code)
    row, code = pairs // max(1, len(count)), pairs % max(1, len(count))
    n = count[code]
    number = number[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    pairs = _each_once(np.repeat(row, n) * max(1, len(names)) + number)
    return pairs // max(1, len(names)), pairs % max(1, len(names)), names


def _apart(distinct: pa.Array, codes: np.ndarray, begins: np.ndarray, restore: Restorer) -> tuple[np.ndarray, list[str]]:
    """(row, feature) of the words that are written apart."""
    few = np.flatnonzero(pc.less_equal(pc.utf8_length(distinct), 2).to_numpy(zero_copy_only=False))
    text = dict(zip(few.tolist(), distinct.take(pa.array(few)).to_pylist(), strict=True))
    short = np.zeros(len(distinct) + 1, bool)
    short[[i for i, t in text.items() if _single(t)]] = True
    at = np.flatnonzero(short[codes])
    if not len(at):
        return np.zeros(0, "int64"), []
    row = np.searchsorted(begins, at, "right") - 1
    new = np.append(True, (np.diff(at) != 1) | (np.diff(row) != 0))
    starts = np.flatnonzero(new)
    rows, out = [], []
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(at)).tolist(), strict=True):
        if b - a >= APART:
            own = features(set(restore.apart("".join(text[c][0] for c in codes[at[a:b]].tolist()))))
            rows += [row[a]] * len(own)
            out += own
    return np.array(rows, "int64"), out


class Classifier:
    """Logistic regression on present features; ``names`` are the features in the order of ``weights``."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.names, self.vector, self.bias = pa.array(names, pa.large_string()), weights, bias
        self.weights = dict(zip(names, weights.tolist(), strict=True))

    def score(self, found: set[str]) -> float:
        """The score of a text with these features."""
        z = self.bias + sum(self.weights.get(f, 0.0) for f in found)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def scores(self, texts: pa.Array, restore: Restorer) -> np.ndarray:
        """The scores of a column."""
        rows, found, _ = present(texts, restore, self.names)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(rows, self.vector[found], len(texts)), -500, 500)))


def _fit(rows: list[tuple[list[int], int]], n: int, l2: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with Adam's step sizes, on all rows at once."""
    own = np.concatenate([np.full(len(x), i) for i, (x, _) in enumerate(rows)]).astype("int64") if rows else np.zeros(0, "int64")
    cols = np.fromiter((c for x, _ in rows for c in x), "int64")
    y = np.array([y for _, y in rows], "float64")
    w, b = np.zeros(n), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(own, w[cols], len(y)), -30, 30)))
        g = p - y
        grad = np.append(np.bincount(cols, g[own], n) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, b


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", broadcast_rows: int = 2_000_000) -> DataFrame:
    """``docs`` with their labels of 0 or 1. Labels are broadcast, so that no text is shuffled, if they are counted to be few enough."""
    labels = labels.where(F.col("label").isin(0, 1)).select(key, F.col("label").cast("int").alias("label"))
    few = labels.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(labels) if few else labels, key)


def fit(rows: DataFrame, model: LetterModel, text: str = "text", label: str = "label", key: str = "doc_id", least: int = 3, train_rows: int = 20_000) -> Classifier | None:
    """A classifier from labelled rows (label 0 or 1); None without rows of both classes.

    Features are counted over all rows. About ``train_rows`` rows, drawn by a hash of key and text, are those that weights are
    fitted on, on the driver, with the features that ``least`` rows of label 1 have and that go with the label.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = rows.where(F.col(label).isin(0, 1)).select(F.col(text).alias("_t"), F.col(label).cast("int").alias("_y"), F.xxhash64(key, text, F.lit(13)).alias("_h"))
    totals = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    if len(totals) < 2:
        return None
    ones, all_ = totals[1], totals[0] + totals[1]

    def count(batches):
        restore = restorer(shared.value)
        for batch in batches:
            for first, part in slices(batch.column(0)):
                toxic = batch.column(1).slice(first, len(part)).to_numpy() == 1
                row, found, names = present(part, restore)
                b = np.bincount(found[toxic[row]], minlength=len(names))
                n = np.bincount(found, minlength=len(names))
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n), pa.array(b)], ["f", "n", "b"])

    counts = rows.select("_t", "_y").mapInArrow(count, "f string, n long, b long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    expected = F.col("n") * ones / all_
    clean = F.col("n") - F.col("b")
    gain = 2 * (F.col("b") * F.log((F.col("b") + 0.01) / expected) + clean * F.log((clean + 0.01) / (F.col("n") - expected)))
    tried = written(counts.where(F.col("b") >= least).select("f", "b", expected.alias("e"), gain.alias("gain")), "features")
    bar = 10 + 2 * math.log(max(1, tried.count()))
    good = tried.where((F.col("b") > F.col("e")) & (F.col("gain") > bar)).select("f")

    def held(batches):
        restore = restorer(shared.value)
        for batch in batches:
            for first, part in slices(batch.column(0)):
                row, found, names = present(part, restore)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype("int32")), names.take(pa.array(found)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(first, len(part)), batch.column(2).slice(first, len(part))], ["x", "y", "h"])

    share = min(1.0, train_rows / all_)
    drawn = rows.where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30)).mapInArrow(held, "x array<string>, y int, h long")
    drawn = written(drawn.select("x", "y", F.monotonically_increasing_id().alias("i")), "drawn")
    # What the driver gets is bounded by the drawn rows: their labels, and those of their features that go with the label.
    found = drawn.select("i", F.explode("x").alias("f")).join(good, "f").groupBy("i").agg(F.collect_list("f").alias("x"))
    sample = drawn.select("i", "y").join(found, "i", "left").select("x", "y").collect()
    names = sorted({f for r in sample for f in r["x"] or ()})
    at = {f: i for i, f in enumerate(names)}
    weights, bias = _fit([([at[f] for f in r["x"] or ()], r["y"]) for r in sample], len(names))
    return Classifier(names, weights, bias)


def judge(docs: DataFrame, model: LetterModel, classifier: Classifier | None, keep: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The ``keep`` columns of each row with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model, classifier))
    kept = [c for c in keep if c not in ("score", "predicted")]

    def score(batches):
        model, classifier = shared.value
        restore = restorer(model)
        for batch in batches:
            for first, part in slices(batch.column("_text")):
                found = classifier.scores(part, restore) if classifier else np.zeros(len(part))
                own = [batch.column(c).slice(first, len(part)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found), pa.array((found >= threshold).astype("int32"))], [*kept, "score", "predicted"])

    rows = docs.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(score, schema)


def restored(docs: DataFrame, model: LetterModel, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of each row with ``words``, the restored words in order of the alphabet."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def words(batches):
        restore = restorer(shared.value)
        for frame in batches:
            yield frame.drop(columns="_text").assign(words=[sorted(restore.words(t)) for t in frame["_text"]])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(words, f"{kinds}, words array<string>")
