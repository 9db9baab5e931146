import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from nymora.llm import conversations
from nymora.llm.grammar import ASKED, CLOSING, KEEP, ROLE, TERMINALS, Grammar, alone, cheapest

SCHEMA = "conv_id long, turn long, role string, text string"


def enumerated(turns):
    """(cost, audit, lines) of the cheapest edits of (role, text, fault), least audit first, with whole strings at every step."""
    best = {0: (0, "", ())}
    for n in range(len(turns) + 1):
        grown = dict(best)
        for _ in range(3):
            for state, (cost, audit, lines) in list(grown.items()):
                new = (cost + 3, audit + "I", (*lines, ROLE[ASKED[state]] + ":"))
                grown[ASKED[state]] = min(grown.get(ASKED[state], new), new)
        if n == len(turns):
            return min(grown[s] for s in (0, 3) if s in grown)
        role, text, fault = turns[n]
        # A turn's insertions come before its edit, so the least of two equally dear beginnings stays the least.
        best = {}
        for state, (cost, audit, lines) in grown.items():
            more = 3 if fault == "truncated" else 0
            moves = [(state, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                moves.append((ASKED[state], (cost + 3 + more, audit + "R", (*lines, f"{ROLE[ASKED[state]]}:{text}"))))
                if role[:1] and state in KEEP.get(role[0], {}):
                    moves.append((KEEP[role[0]][state], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
            for to, new in moves:
                best[to] = min(best.get(to, new), new)


def brute(rows, conv):
    """The contract's row of a conversation; rows are (conv_id, turn, role, text) after damage, equal turns by role."""
    own = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv), key=lambda o: (o[0] is not None, o[0] or 0, o[1]))
    seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in own:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role, text, fault))
        if fault:
            counts[fault] += 1
    numbers = [t for t, _, _ in own if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    cost, audit, lines = enumerated(turns)
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def made_up(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(0, longest)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None, "User"], [8, 8, 2, 1, 0.3, 0.3, 0.3])[0]
            text = rng.choices([f"Words {rng.random()}.", "Same text!", " \t\n", "", None, f"cut {rng.random()}", "Ünd so?\n "], [9, 2, 1, 1, 0.5, 2, 1])[0]
            rows.append((c if c else None, rng.choices([t, None, t + 40], [20, 1, 1])[0], role, text))
    # Ties are broken by role here; of equal turn and role only equal texts are kept.
    first = {}
    return [r for r in rows if first.setdefault(r[:3], r[3]) == r[3]]


@pytest.mark.parametrize("piece_rows", [1, 3, 4096])
def test_repair_equals_enumeration(spark, piece_rows):
    rows = made_up(piece_rows, 60, 9)
    rows += [r for r in rows if r[0] == 5]  # repeated rows
    ids = spark.createDataFrame([(r[0],) for r in rows] + [(777,)], "conv_id long")
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", piece string")
    want = sorted((brute(rows, c) for c in {r[0] for r in rows} | {777}), key=repr)
    assert result(conversations.repaired(df, ids, piece_rows=piece_rows)) == want
    assert next(w for w in want if w[0] == 777)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(4)
    roles = ["user", "assistant"]
    rows = [(1, t, roles[t % 2] if rng.random() < 0.9 else rng.choice(roles), rng.choice(["One.", f"{t}!", f"open {t}", ""])) for t in range(3000)]
    rows += [(c, t, roles[t % 2], f"{c} {t}.") for c in range(2, 300) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for piece_rows, piece_bytes in ((100, 1 << 18), (4096, 5000)):
        out = result(conversations.repaired(df, piece_rows=piece_rows, piece_bytes=piece_bytes, block_bytes=4000))
        assert next(r for r in out if r[0] == 1) == brute(rows, 1)
        assert len(out) == 299 and all(r[7] == "KKKK" and r[6] == 0 for r in out if r[0] != 1)


def test_damage_and_defined_cases(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Go on. Then {t}!") for c in range(40) for t in range(6)] + [(None, None, None, None), (None, 1, "system", "Hm.")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = conversations.damaged(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert result(conversations.repaired(got, df)) == sorted((brute(want, c) for c in {r[0] for r in rows}), key=repr)
    assert conversations.repaired(df.where("false"), df.where("false")).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 1_000_000)], SCHEMA)
    assert [(r.cost, r.audit, r.truncated) for r in conversations.repaired(long).collect()] == [(3, "KK", 1)]
    text_ids = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.audit) for r in conversations.repaired(text_ids).collect()] == [("a", "KK")]


def test_grammar_equals_enumeration():
    as_turn = {c: ({"s": "system", "u": "user", "a": "assistant", "o": "tool"}.get(c.lower(), "user"), "", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in TERMINALS}
    rng = random.Random(1)
    every = ["".join(p) for n in (1, 2, 3) for p in itertools.product(TERMINALS, repeat=n)]
    every += ["".join(rng.choices("suauauaSUAox", k=rng.randint(4, 40))) for _ in range(400)] + ["u" * 37, "ua" * 64, "x" * 11]
    grammar = Grammar(every)
    costs, to = alone(*grammar.matrices(every))
    audits = grammar.audits([(s, 0, int(t)) for s, t in zip(every, to, strict=True)])
    for s, cost, t, audit in zip(every, costs, to, audits, strict=True):
        assert (cost, audit + CLOSING[int(t)]) == enumerated([as_turn[c] for c in s])[:2], s
    for s in every[-300:]:
        cut = [s[i : i + 3] for i in range(0, len(s), 3)]
        pieces = Grammar(cut)
        cost, states = cheapest(*pieces.matrices(cut))
        assert (cost, "".join(pieces.audits(list(zip(cut, states, states[1:], strict=False)))) + CLOSING[states[-1]]) == enumerated([as_turn[c] for c in s])[:2]
    shared = Grammar(["ua" * 1024, "ua" * 2048])
    assert len(shared.left) < len(TERMINALS) + 20  # a rule a doubling
    for bad in (["u", ""], ["uz"]):
        with pytest.raises(ValueError):
            Grammar(bad)


def test_query_keeps_every_conversation(spark, tables):
    from nymora.llm import queries

    out = queries.op11_conversations(spark, tables)
    rows = [tuple(r) for r in conversations.damaged(spark.read.parquet(f"{tables}/conversations.parquet")).collect()]
    ids = {r[0] for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id").distinct().collect()}
    assert result(out) == sorted((brute(rows, c) for c in ids), key=repr)
    assert out.where(F.col("gaps") < 0).count() == 0
