import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from nymora.llm import decontaminate, langid, line_dedup, queries, secrets, toxicity, url_filter
from nymora.llm.common import fold


# --- decontamination ------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(text, items):
    w, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        iw = words_of(item_text)
        size = min(13, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add("null" if item is None else str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Short item"), (10, "w5 w6 W7"), (3, None), (4, "..."), (None, "nameless words here"), (1, "short ITEM")]
TEXTS = [None, "", "x " + " ".join(f"w{i}" for i in range(16)) + " y", "a short item. short item", "w5, w6; w7 w8", " ".join(f"w{i}" for i in range(12)), "nameless words here " * 3, "é short item é" * 2, "pad " * 300 + "short item"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_matches_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "kept")], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.judge(docs, bench, ["doc_id", "n_hit"], block_bytes=block_bytes).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(TEXTS[r.doc_id], ITEMS)


def test_decontamination_without_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = decontaminate.judge(docs, spark.createDataFrame([], "item_id long, text string"), ["doc_id"]).collect()
    assert [(r.n_hit, r.contaminated) for r in out] == [(0, False)] * 2
    assert decontaminate.judge(docs.where("false"), spark.createDataFrame(ITEMS, "item_id long, text string"), ["doc_id"]).count() == 0


# --- languages ---------------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op4_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_texts(spark):
    rows = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog " * 30, "en"), ("der hund und die katze " * 30, "de"), ("x", None), (None, "en")])], "doc_id long, text string, lang string")
    model = langid.fit(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "Die Katze und der Hund"), (5, "THE!! DOG## AND$ the cat")], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert [out[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "de", "en"]
    assert all(out[i].rejected and out[i].score == 0 for i in (1, 2, 3))
    assert not out[4].rejected and langid.Model([("a", b"same words here"), ("b", b"same words here")]).predict("same words " * 200)[3]
    long = langid.identify(spark.createDataFrame([(1, "der Hund und die Katze " * 50_000)] * 2, "doc_id long, text string"), model, ["doc_id"]).collect()
    assert [r.lang_pred for r in long] == ["de", "de"] and langid.identify(odd.where("false"), model, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        langid.fit(rows, max_languages=1)
    nothing = langid.fit(rows.where("false"))
    assert [r.lang_pred for r in langid.identify(odd, nothing, ["doc_id"]).collect()] == ["und"] * 5


# --- lines ----------------------------------------------------------------------------------------------------------------


def brute_lines(docs, min_docs=10, min_tokens=3, depth=3, similarity=0.6, long_docs=3, long_tokens=50):
    """The rule of ``line_dedup`` in plain Python, for texts that hold a template of few texts once each."""
    mask = lambda line: " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split(" "))
    rows = {(d, t): [mask(x) for x in t.split("\n")] for d, t in docs}
    leaves = defaultdict(list)
    for own in rows.values():
        for x in own:
            leaves[len(x.split(" ")), tuple(x.split(" ")[:depth])].append(x)
    template = {}
    for (size, _), own in leaves.items():
        fields = []
        if size >= min_tokens and len(own) >= min_docs and len(set(own)) > 1:
            fields = [p for p in range(size) if 2 * Counter(x.split(" ")[p] for x in own).most_common(1)[0][1] < len(own)]
        good = fields and len(fields) <= size * (1 - similarity)
        for x in own:
            template[x] = " ".join("<*>" if good and p in fields else t for p, t in enumerate(x.split(" ")))
    held = defaultdict(dict)  # template -> text -> its lines; copies of a text count once
    for (_, t), own in rows.items():
        for x in own:
            if len(x.split(" ")) >= min_tokens:
                held[template[x]][t] = own
    gone = {t for t, by in held.items() if len(by) >= min_docs}
    few = {t for t, by in held.items() if len(t.split(" ")) >= long_tokens and long_docs <= len(by) < min_docs}
    while True:  # recurring lines are no surroundings, so each round may find more
        more = set()
        for t in few:
            before, after = set(), set()
            for own in held[t].values():
                at = next(i for i, x in enumerate(own) if template[x] == t)
                up = next((x for x in own[:at][::-1] if template[x] not in gone), None)
                down = next((x for x in own[at + 1 :] if template[x] not in gone), None)
                before.add(("line", up) if up is not None else ("edge", down))
                after.add(("line", down) if down is not None else ("edge", up))
            n = max(len(before), len(after))
            if n >= long_docs or 2 * n > len(held[t]):
                more.add(t)
        if not more:
            break
        gone |= more
        few -= more
    return {d: "\n".join(x for x in t.split("\n") if len(x.split(" ")) < min_tokens or template[mask(x)] not in gone) for d, t in docs}


def test_recurring_templates_go_and_copies_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    prose = lambda: " ".join(word() for _ in range(12))
    docs = [(i, f"{prose()}\nAll rights reserved by us\n{prose()}\nPage {i} of {i * 7} was printed\n{prose()}\nSigned today by {word()} at the office\nok") for i in range(30)]
    copied = "\n".join(prose() for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    docs += [(60 + i, f"{prose()}\n{passage}\n{prose()}") for i in range(3)]
    near = [" ".join(word() for _ in range(60)) for _ in range(5)]
    docs += [(80 + i, "\n".join(x if j != i % 5 else f"{x} {word()}" for j, x in enumerate(near))) for i in range(5)]
    docs += [(100 + i, copied) for i in range(40)] + [(200, "All rights reserved by us"), (201, ""), (202, "short")]
    df = spark.createDataFrame([*docs, (300, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.deduplicated(df).collect()}
    want = brute_lines(docs)
    assert {d: r.text for d, r in out.items()} == {**want, 300: None}
    assert all("rights" not in want[i] and "printed" not in want[i] and "Signed" not in want[i] for i in range(30))
    assert all(passage not in want[60 + i] and want[80 + i] == dict(docs)[80 + i] for i in range(3))
    assert out[100].text == copied and out[200].text == "" and out[300].n_lines == 0 and out[5].n_dropped == 3


def test_blocks_edges_and_copies_recur(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    prose = lambda n=12: " ".join(word() for _ in range(n))
    head, foot, often = prose(5), [prose(5) for _ in range(4)], prose(5)
    docs = [(i, "\n".join([head, *(prose() for _ in range(6)), *foot])) for i in range(12)]
    docs += [(20 + i, f"{often}\n{prose()}" if i % 2 else f"{prose()}\n{often}") for i in range(12)]
    copied = f"{prose()}\n{often}\n{prose()}"
    docs += [(40 + i, copied) for i in range(40)]
    long = [prose(60) for _ in range(3)]
    docs += [(100 + i, "\n".join([prose(), *long, *(prose() for _ in range(3))])) for i in range(3)]
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = {d: t.split("\n") for d, t in docs}
    assert all(out[i] == text[i][1:7] for i in range(12))
    assert all(len(out[20 + i]) == 1 and often not in out[20 + i] for i in range(12))
    assert all(out[40 + i] == [text[40][0], text[40][2]] for i in range(40))
    assert all(out[100 + i] == [text[100 + i][0], *text[100 + i][-3:]] for i in range(3))


def test_documents_of_mostly_boilerplate_lose_it(spark):
    rng = random.Random(4)
    prose = lambda n=12: " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(n))
    menu = [prose(5) for _ in range(4)]
    docs = [(i, "\n".join([*menu[:2], prose(), *menu[2:]])) for i in range(12)]
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {i: (t.split("\n")[2], 4) for i, t in docs}


def test_lines_of_nothing(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- secrets -----------------------------------------------------------------------------------------------------------------


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(secrets.ASSIGN.replace(r"\x20", " "), text, re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_match_plain_regexes(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    odd = ["", "🔑 Password: 'abcdef' é apikey=12345 api_KEY := x", "token = \"" + "0af" * 14 + "\" AKIA" + "Q" * 16 + " AKIAQ", "secret=aaaaaa token:bbbbbbb\n" * 300, "x" + "0f" * 15 + "g" + "12" * 15]
    docs += [(10_000 + i, t) for i, t in enumerate(odd)]
    rows = secrets.digest(secrets.scan(spark.createDataFrame([*docs, (20_000, None), (20_000, None)], "doc_id long, text string"))).collect()
    assert len(rows) == len(docs) + 2
    texts = dict(docs)
    for r in rows:
        want = base_spans(texts.get(r.doc_id, ""))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in secrets.KINDS[:3])
        listed = [f"{k}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))


def words_of_letters(rng, n=800):
    return ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n)]


def test_random_runs_are_told_from_words_and_patterns(spark):
    rng = random.Random(5)
    words = words_of_letters(rng)
    prose = lambda n: " ".join(rng.choices(words, k=n))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    good = ["".join(rng.choices(alphabet, k=k)) for k in (20, 24, 32, 40, 64, 600, 9000) for _ in range(20)]
    bad = ["a1" * 20, "build_2024_release_candidate_1_x_x_x_x", "version-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "0000000000000000000000000000000000a1"] * 5
    bad += ["/".join(rng.choices(words, k=6)) for _ in range(100)] + ["".join(w.capitalize() for w in rng.choices(words, k=4)) for _ in range(100)]
    df = spark.createDataFrame([(i, f"{prose(40)} {t} {prose(5)}") for i, t in enumerate(good + bad)], "doc_id long, text string")
    out = {r.doc_id: [s.value for s in r.random] for r in secrets.scan(df).collect()}
    assert sum(t in out[i] for i, t in enumerate(good)) >= 0.9 * len(good)
    assert sum(bool(out[len(good) + i]) for i in range(len(bad))) <= 0.05 * len(good)
    assert secrets.scan(df.where("false")).count() == 0


def brute_uncovered(text, least=16):
    base = [False] * len(text)
    for _, a, b in base_spans(text):
        base[a:b] = [True] * (b - a)
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        for part in re.finditer("1+", "".join("0" if base[i] else "1" for i in range(*m.span()))):
            a, b = m.start() + part.start(), m.start() + part.end()
            if b - a >= least and re.search("[A-Za-z]", text[a:b]):
                out.append((a, b, text[a:b]))
    return out


def brute_battery(value):
    names = [(n, x) for n, p, x in secrets.ALPHABETS if re.match(p, value)]
    name, letters = names[0]
    own = value.rstrip("=") or value
    own = own.lower() if name in ("hex", "base36") else own
    x, n, k = [letters.index(c) + 1 if c in letters else 0 for c in own], len(own), len(letters)
    cdf = lambda z: 1 / (1 + math.exp(-(1.5976 * z + 0.07056 * z**3)))
    two = lambda z: 2 * (1 - cdf(abs(z)))
    chi2 = max(0, k / n * sum(c * c for c in Counter(x).values()) - n)
    d = k - 1
    p = [1 - cdf(((chi2 / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))]
    high = [v > k / 2 for v in x]
    up = sum(high)
    runs, mean = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), 2 * up * (n - up) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p.append(0.5 ** (n - 1) if up in (0, n) else two((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    mu = sum(x) / n
    power = sum((v - mu) ** 2 for v in x)
    p.append(two((sum((a - mu) * (b - mu) for a, b in zip(x, x[1:], strict=False)) / power + 1 / n) * math.sqrt(n)) if power > 1e-9 else 0.0)
    return name, p


def test_runs_and_tests_match_brute_force(spark):
    rng = random.Random(8)
    words = words_of_letters(rng)
    junk = "ABCDEFabcdef0123456789+/_=-"
    texts = []
    for i in range(80):
        run = "".join(rng.choices(junk if i % 2 else "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789", k=rng.randint(10, 90)))
        texts.append(" ".join([*rng.choices(words, k=5), f"é🔑 token={run[:9]} x{run}{'0af3' * rng.randint(4, 9)}{run}", *rng.choices(words, k=3), "AKIA" + "Q" * rng.randint(10, 20) + run]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = secrets.matches(df, "text", "doc_id", 16)
    row = {r["_row"]: r.doc_id for r in found.select("doc_id", "_row").collect()}
    spans = secrets.positioned(found).where("kind <> 'access' or length(value) >= 20")
    spans = spans.where((spans.kind != "assign") | spans.value.rlike("(?i)[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"))
    runs = secrets._uncovered(spans, 16)
    got = sorted((row[r["_row"]], r.start, r.end, r.value) for r in runs.collect())
    assert got == sorted((i, *part) for i, t in enumerate(texts) for part in brute_uncovered(t)) and len(got) > 80
    for r in secrets.battery(runs.select("value")).collect():
        name, p = brute_battery(r.value)
        assert r.encoding == name and all(abs(a - b) < 1e-9 for a, b in zip((r.p_chi2, r.p_runs, r.p_serial), p, strict=True))


def test_many_matches_in_one_text(spark):
    r = secrets.digest(secrets.scan(spark.createDataFrame([(1, "secret=aaaaaa token:bbbbbbb x\n" * 10_000)], "doc_id long, text string"))).head()
    assert r.n_assign == 20_000 and r.spans.endswith(f"assign:{30 * 9_999 + 14}:{30 * 9_999 + 27}")


# --- toxicity ------------------------------------------------------------------------------------------------------------------


def letters_of(words):
    return toxicity.LetterModel(toxicity.gram_counts(pa.array([" ".join(words), None, "", "the. And!"])))


WORDS = "idiot stupid moron loser pathetic worthless trash clown the and with this that some good word ".split() * 50


def gram(text):
    n = 0
    for c in text:
        n = n * toxicity.CLASSES + (0 if c == toxicity.EDGE else toxicity.letter_class(c))
    return n


def test_disguised_words_are_restored():
    model = letters_of(WORDS)
    edge = toxicity.EDGE
    assert model.counts[gram(f"the{edge}")] == 51 and model.counts[gram(edge * 3 + "a")] == 51 and model.counts.sum() == sum(len(w) + 1 for w in [*WORDS, "the", "and"])
    restore = toxicity.Restorer(model)
    odd = {"1d10t": "idiot", "$tup1d!!": "stupid", "moooron": "moron", "L0SER": "loser", "p@thet1c": "pathetic", "w0rthle$s": "worthless", "c.l.o.w.n": "clown", "you i d i o t !": "idiot", "t r 4 s h": "trash", "stu" + "u" * 60 + "pid": "stupid",
           "g.o.o.d._._1.d.1.0.t": "idiot", "t h e m o r o n a n d t h e c l o w n " * 30 + "l o s e r": "loser"}
    for text, word in odd.items():
        assert word in restore.words(text), text
    texts = ["1d10t moron moron", None, "", "s c u m and t r 4 s h", "x idi0t!!", "Moron, moronic"]
    for names in (None, pa.array(["idiot", "moron", "moron-", "trash"], pa.large_string())):
        rows, found, known = toxicity.present(pa.array(texts), restore, names)
        known = known.to_pylist()
        want = sorted((i, f) for i, t in enumerate(texts) for f in toxicity.features(restore.words(t)) if names is None or f in known)
        assert sorted(zip(rows.tolist(), (known[j] for j in found.tolist()), strict=True)) == want
    assert restore.words("This, that.") == {"this", "that"} and restore.words(None) == restore.words("") == set()


def price(reading, model):
    total, past = 0.0, 0
    for letters, cost in reading:
        total += cost
        for c in letters:
            if c == " ":
                if past:
                    total += model.cost[past * toxicity.CLASSES] + (toxicity.LONE if past < toxicity.CLASSES else 0)
                    past = 0
                else:
                    return math.inf
            else:
                total += model.cost[past * toxicity.CLASSES + toxicity.letter_class(c)]
                past = (past * toxicity.CLASSES + toxicity.letter_class(c)) % toxicity.STATES
    return total + (model.cost[past * toxicity.CLASSES] + (toxicity.LONE if past < toxicity.CLASSES else 0) if past else 0)


def test_viterbi_is_the_cheapest_of_all_readings():
    rng, model = random.Random(4), letters_of(WORDS)
    for _ in range(150):
        token = "".join(rng.choices("idiotstup01345!$.-aé", k=rng.randint(1, 6)))
        places = toxicity.lattice(token, rng.random() < 0.5)
        by = {}
        for reading in itertools.product(*places):
            text = "".join(x for x, _ in reading)
            by[text] = min(by.get(text, math.inf), price(reading, model))
        assert abs(by[toxicity.viterbi(places, model)] - min(by.values())) < 1e-9, token


def test_many_states_at_once_are_the_same(monkeypatch):
    """One by one, as arrays, and settled often or never: the same costs, also in runs of signs of any length."""
    rng, model = random.Random(5), letters_of(WORDS)
    for k in (1, 3, 9, 40, 300):
        token = "".join(rng.choices("0123456789$@!idto", k=k)) + "".join(rng.choices("0123456789$@!", k=k))
        places, found = toxicity.lattice(token, k == 9), []
        for many, settle in ((0, 256), (0, 2), (1 << 30, 7), (64, 1 << 30)):
            monkeypatch.setattr(toxicity, "MANY", many)
            monkeypatch.setattr(toxicity, "SETTLE", settle)
            reading = toxicity.viterbi(places, model)
            found.append(reading)
        assert len(set(found)) == 1, token


def test_words_in_long_runs_of_signs_are_restored():
    restore = toxicity.Restorer(letters_of(WORDS))
    for token, word in (("id1._.0_._7", "idiot"), ("p@7h37-1-_-_-c", "pathetic"), ("cl-_-*-.-0*_-wn", "clown")):
        assert max(map(len, re.findall(r"[\W\d_]+", token))) > 8 and word in restore.words(token), token
    began = time.perf_counter()
    assert restore.words("a" + "0123456789" * 500 + "b")
    assert time.perf_counter() - began < 60


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in out if r.toxic == 1], [r.score for r in out if r.toxic == 0]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.8 * len(good) * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a word", 3.0), (2, None, 3.0), (2, None, 3.0), (None, "x" * 200_000 + " 1" * 50_000, None)], "doc_id long, text string, score double")
    model = toxicity.letter_model(docs)
    rows = docs.selectExpr("doc_id", "text", "cast(null as int) label")
    assert toxicity.fit(rows, model) is None
    assert [r.score for r in toxicity.judge(docs, model, None, docs.columns).collect()] == [0.0] * 4
    assert toxicity.judge(docs.where("false"), toxicity.letter_model(docs.where("false")), None, ["doc_id"]).count() == 0
    labelled = spark.createDataFrame([(i, "you idiot" if i % 3 == 0 else "fine words", int(i % 3 == 0)) for i in range(90)] + [(None, None, 0)], "doc_id long, text string, label int")
    classifier = toxicity.fit(labelled, model)
    out = {(r.doc_id, r.text): r.score for r in toxicity.judge(labelled.union(labelled.where("doc_id < 3")), model, classifier, ["doc_id", "text"]).collect()}
    assert out[0, "you idiot"] > 0.5 > out[1, "fine words"] and out[None, None] < 0.5 and len(set(out.values())) == 2


# --- URLs ------------------------------------------------------------------------------------------------------------------------

RULES = [*queries.URL_RULES, ("org/aaaaaaaaaaaa/", "allow"), ("a.com/x", "block"), ("a.com/x/y/", "allow"), ("b.org/", "block"), ("c.b.org/q", "allow")]
URLS = [None, "", "no url", "http://com/", "http://com", "HTTP://WWW.Example.COM/en/p?q#f", "https://m.example.com/en", "http://example.com/en/1", "http://x.net/es/2", "http://notexample.com/en/",
        "s://a.com/xyz", "s://a.com/x/y/z", "s://a.com/x/yz", "s://c.b.org/qq/1", "s://c.b.org/r", "s://b.org?x", "s://d.c.b.org/q#", "x://", "a://b://c/d", "s://c.b.org/aaaaaaaaaaaa/q"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h.count("."), v == "block", f"{h}{p}", v) for (h, p), v in ((("" + r).partition("/")[::2], v) for r, v in RULES) for p in [f"/{p}"] if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    for out in (url_filter.URLFilter(RULES).judge(df), url_filter.judge_joined(df, rules)):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: brute_url(u) for i, u in enumerate(URLS)}
    with pytest.raises(ValueError):
        url_filter.URLFilter(RULES, max_rules=2)


def test_fold_is_the_crc_of_the_id(spark):
    import zlib

    out = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", fold().alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in out)
