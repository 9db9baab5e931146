import json
import random
import re

import pytest
from pyspark.sql import functions as F

from nymora import cli
from nymora.engine import Engine
from nymora.functions import native, scan
from nymora.functions.hits import disjoint
from nymora.functions.scan import KnownNames
from nymora.functions.sql import register
from nymora.functions.surrogates import Custom, Placeholders, Realistic
from nymora.functions.lookup import JSONStream, TextStream, Lookup, restore, restore_json
from nymora.operators import audit, documents, evaluate, spans
from nymora.operators import mask as masking
from nymora.operators import restore as restoring
from nymora.operators.ner import SpacyNames
from nymora.sources import corpus
from nymora.sources import vault as vaults
from nymora.streaming import restore as streams

TEXTS = [
    (1, "mail bob@example.com and ⟨EMAIL_1⟩ or ⟨email_3⟩"),
    (2, "bob@example.com ann@a.org 4111 1111 1111 1111"),
    (3, None),
    (4, "ip 8.8.8.8 🔑 ann@a.org"),
    (5, ""),
]


@pytest.fixture(scope="module")
def batch(spark):
    df = spark.createDataFrame(TEXTS, "ord long, text string")
    engine = Engine(spark)
    return engine, engine.mask(df), df


def test_numbers_follow_reading_order_and_skip_literals(batch):
    engine, masked, _ = batch
    got = {r.ord: r.masked for r in masked.collect()}
    assert got == {1: "mail ⟨EMAIL_2⟩ and ⟨EMAIL_1⟩ or ⟨email_3⟩", 2: "⟨EMAIL_2⟩ ⟨EMAIL_4⟩ ⟨CARD_1⟩", 3: None, 4: "ip ⟨IPV4_1⟩ 🔑 ⟨EMAIL_4⟩", 5: ""}
    assert [(r.ord, r.type, r.original) for r in engine.vault.orderBy("ord").collect()] == [(0, "EMAIL", "bob@example.com"), (1, "EMAIL", "ann@a.org"), (2, "CARD", "4111 1111 1111 1111"), (3, "IPV4", "8.8.8.8")]


def test_every_way_of_restoring(spark, batch):
    engine, masked, _ = batch
    want = dict(TEXTS)
    for out in (engine.restore(masked), engine.restore(masked, tolerant=False), restoring.restore(masked, engine.vault, tolerant=False, broadcast_rows=0), restoring.restore(masked, engine.vault, broadcast_rows=3)):
        assert {r.ord: r.restored for r in out.collect()} == want


def test_second_batch_reuses_the_vault(spark, batch):
    engine, _, _ = batch
    again = Engine(spark, vault=engine.vault)
    out = again.mask(spark.createDataFrame([(1, "new@x.org then ann@a.org")], "ord long, text string")).head()
    assert out.masked == "⟨EMAIL_3⟩ then ⟨EMAIL_4⟩"
    with pytest.raises(vaults.VaultError):  # the text holds a surrogate that the vault already gave
        again.mask(spark.createDataFrame([(1, "ann@a.org is ⟨EMAIL_2⟩")], "ord long, text string"))
    assert again.vault.count() == 5


def test_vaults_are_apart(spark):
    df = spark.createDataFrame([("a", 1, "x@y.org"), ("b", 1, "z@y.org x@y.org"), ("b", 2, "x@y.org")], "v string, ord long, text string")
    engine = Engine(spark)
    assert {(r.v, r.ord): r.masked for r in engine.mask(df, vault_id="v").collect()} == {("a", 1): "⟨EMAIL_1⟩", ("b", 1): "⟨EMAIL_1⟩ ⟨EMAIL_2⟩", ("b", 2): "⟨EMAIL_2⟩"}
    masked = engine.mask(df, vault_id="v")
    assert all(r.restored == r.text for r in engine.restore(masked, vault_id="v").collect())


def test_realistic_and_custom_surrogates(spark):
    df = spark.createDataFrame([(1, "Jane met x@y.org, +1 212 555 0134; Blair Alder knows 4111111111111111")], "ord long, text string")
    engine = Engine(spark, names=[KnownNames(persons=["jane"])], generator=Realistic())
    out = engine.mask(df).head().masked
    assert out.startswith("Casey Alder met user1@example.org, 202-555-0101; Blair Alder knows 51000000")
    assert scan.luhn_ok(re.sub(r"\D", "", out.split("knows ")[1]))
    own = Engine(spark, generator=Custom(lambda t, o, n: f"<<{t.lower()} {n}>>"), detectors=["email"])
    assert own.mask(df).head().masked.startswith("Jane met <<email 1>>,")
    templated = Engine(spark, generator=Placeholders("[{type}-{n}]"), detectors=["email"])
    assert templated.mask(df).head().masked.startswith("Jane met [EMAIL-1],")


def test_audit(spark, batch):
    engine, _, df = batch
    texts = spark.createDataFrame([(1, "see bob@example.com, new@x.org and ⟨EMAIL_2⟩"), (2, None), (3, "bob@example.combob@example.com")], "ord long, text string")
    for rows in (200_000, 4):
        out = {r.ord: [(f.kind, f.value, f.start) for f in r.findings] for r in audit.findings(texts, engine.vault, broadcast_rows=rows).collect()}
        assert out == {1: [("leaked_original", "bob@example.com", 4), ("new_pii", "new@x.org", 21)], 2: [], 3: [("leaked_original", "bob@example.com", 0), ("leaked_original", "bob@example.com", 15)]}
    assert {(r.ord, r.value, r.start) for r in audit.leaked_joined(texts, engine.vault, "ord").collect()} == {(1, "bob@example.com", 4), (3, "bob@example.com", 0), (3, "bob@example.com", 15)}
    joined = {(r.ord, r.kind, r.value, r.start) for r in audit.findings_joined(texts, engine.vault, "ord").collect()}
    assert joined == {(o, *f) for o, fs in out.items() for f in fs}
    with pytest.raises(ValueError):
        audit.findings(texts, engine.vault, broadcast_rows=0)
    assert all(f.kind == "leaked_original" for r in audit.findings(texts, engine.vault, detectors=[]).collect() for f in r.findings)


def test_vault_json(spark, batch, tmp_path):
    engine, _, _ = batch
    path = str(tmp_path / "vault.json")
    vaults.save(engine.vault, path)
    assert sorted(map(tuple, vaults.load(spark, path).collect())) == sorted(map(tuple, engine.vault.collect()))
    good = {"type": "EMAIL", "original": "a", "surrogate": "b"}
    bad = [{}, {"mappings": {}}, {"version": 2, "mappings": []}, {"version": True, "mappings": []}, {"version": 1.0, "mappings": []}, {"mappings": [good, good]}, {"mappings": [good, {**good, "original": "c"}]}]
    bad += [{"mappings": [{**good, **x}]} for x in ({"original": ""}, {"surrogate": "a"}, {"type": "X"}, {"detector": 1}, {"original": "\ud800"})]
    for data in [*map(json.dumps, bad), '{"mappings":[],"mappings":[]}', "[" * 100_000, "{"]:
        with pytest.raises(vaults.VaultError):
            vaults.parse(data)
    (tmp_path / "link").symlink_to(path)
    with pytest.raises(vaults.VaultError):
        vaults.save(engine.vault, str(tmp_path / "link"))
    with pytest.raises(vaults.VaultError):
        vaults.checked(engine.vault.union(engine.vault))
    vaults.write(engine.vault, str(tmp_path / "table"))
    assert vaults.read(spark, str(tmp_path / "table")).count() == engine.vault.count()
    key = vaults.generate_key()
    assert sorted(map(tuple, vaults.decrypted(vaults.encrypted(engine.vault, key), key).collect())) == sorted(map(tuple, engine.vault.collect()))


PAIRS = [("⟨EMAIL_1⟩", "a@b.c"), ("⟨EMAIL_12⟩", "x"), ("Avery Alder", 'Jane "J" Doe'), ("Avery", "Al"), ("aab", "1"), ("ab", "2")]


def test_tolerant_restoration():
    lookup = Lookup(PAIRS)
    assert restore("avery  alder's AVERY\nALDER averyalder avery alderman ⟨email_1⟩x", lookup) == 'Jane "J" Doe\'s Jane "J" Doe averyalder Al alderman a@b.cx'
    assert restore("Averyx xAvery avery", lookup, False) == "Alx xAl avery"
    assert restore("x", Lookup([("Aa", "1"), ("aA", "2")])) == "x" and restore("aa", Lookup([("Aa", "1"), ("aA", "2")])) == "aa"
    assert restore("avery castilló", Lookup([("Avery Castillo", "1")])) == "avery castilló"


def test_streams_don_t_depend_on_chunks():
    rng, lookup = random.Random(3), Lookup(PAIRS)
    pattern = re.compile("|".join(re.escape(s) for s, _ in sorted(PAIRS, key=lambda p: -len(p[0]))))
    for _ in range(300):
        text = "".join(rng.choice(["⟨EM", "AIL_1", "2⟩", "⟩", "Avery", " Alder", "a", "b", "aab", " ", "⟨"]) for _ in range(12))
        want = pattern.sub(lambda m: dict(PAIRS)[m[0]], text)
        stream, out, at = TextStream(lookup), "", 0
        while at < len(text):
            n = rng.randint(1, 5)
            out += stream.feed(text[at : at + n])
            stream = TextStream.load(lookup, stream.state())
            at += n
        assert out + stream.feed("", True) == want == restore(text, lookup, False)
        doc = json.dumps({"⟨EMAIL_1⟩": [text, 1.5, {"k": text}]}, ensure_ascii=rng.random() < 0.5)
        assert json.loads(restore_json(doc, lookup)) == {"⟨EMAIL_1⟩": [want, 1.5, {"k": want}]}
        stream, out = JSONStream(lookup), ""
        for c in doc:
            out += stream.feed(c)
            stream = JSONStream.load(lookup, stream.state())
        assert out + stream.feed("", True) == restore_json(doc, lookup)


def test_structured_stream(spark, batch, tmp_path):
    engine, masked, _ = batch
    rows = []
    for r in masked.where("masked is not null").collect():
        parts = [r.masked[i : i + 4] for i in range(0, max(1, len(r.masked)), 4)]
        rows += [(str(r.ord), b, i, p, i == len(parts) - 1) for b in (0, 1) for i, p in enumerate(parts)]
    random.Random(1).shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], streams.CHUNKS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(streams.CHUNKS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = engine.restore_stream(source, idle=None).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("restored").orderBy("seq").collect():
        got[r.stream_id, r.block] = got.get((r.stream_id, r.block), "") + r.text
    want = {(str(o), b): t for o, t in TEXTS if t is not None for b in (0, 1)}
    assert got == want
    whole = engine.restore_stream(spark.createDataFrame(rows, streams.CHUNKS))
    assert whole.count() == len(rows)


def test_documents_and_messages(spark):
    chat = json.dumps([{"role": "user", "content": [{"type": "text", "text": "I am x@y.org"}, {"type": "image", "data": "x@y.org"}]}, {"role": "assistant", "refusal": "no x@y.org", "tool_calls": [{"id": "x@y.org", "function": {"arguments": '{"password":"hunter","n":1.10,"to":"x@y.org"}'}}]}])
    blocks = json.dumps({"role": "user", "content": [{"type": "tool_use", "id": "1", "input": {"to": ["x@y.org"], "password": "p"}}, {"type": "tool_result", "content": "got x@y.org"}, {"type": "document", "title": "x@y.org", "source": {"type": "text", "data": "x@y.org"}}, {"type": "search_result", "source": "x@y.org", "content": [{"type": "text", "text": "x@y.org"}]}, {"type": "thinking", "thinking": "x@y.org"}]})
    items = json.dumps(["x@y.org", {"type": "message", "content": [{"type": "input_text", "text": "x@y.org"}]}, {"type": "function_call_output", "output": "x@y.org"}, {"type": "reasoning", "summary": [{"text": "x@y.org"}], "encrypted_content": "x@y.org"}])
    for style, text, left in (("chat", chat, 2), ("blocks", blocks, 1), ("items", items, 1), ("values", chat, 0)):
        df = spark.createDataFrame([(1, text)], "ord long, text string")
        masked, vault = documents.mask_documents(df, vaults.empty(spark), style=style)
        out = masked.head().masked
        assert out.count("x@y.org") == left, style
        assert json.loads(documents.restore_documents(masked, vault, style=style).head().restored) == json.loads(text)
        assert style not in ("chat", "values") or "1.10" in out
    for bad in ('{"x@y.org":1}', '{"a":'):
        with pytest.raises(vaults.VaultError):
            documents.mask_documents(spark.createDataFrame([(1, bad)], "ord long, text string"), vaults.empty(spark))
    cut = spark.createDataFrame([('{"a":"⟨EMAIL_1⟩ and ⟨EM',)], "masked string")
    known = vaults.from_json(spark, '{"mappings":[{"type":"EMAIL","original":"q\\"@y.org","surrogate":"⟨EMAIL_1⟩"}]}')
    assert documents.restore_documents(cut, known).head().restored == '{"a":"q\\"@y.org and ⟨EM'


def test_resolution_in_the_jvm_equals_the_scanner(spark):
    rng = random.Random(9)
    cases = [[scan.Hit("T", s := rng.randrange(30), s + rng.randint(1, 9), "d", rng.choice((0.5, 0.9, 1.0))) for _ in range(rng.randrange(9))] for _ in range(60)]
    rows = [(i, [(h.type, "", h.start, h.end, h.detector, h.confidence) for h in c]) for i, c in enumerate(cases)]
    out = spark.createDataFrame(rows, f"id int, e {spans.ENTITIES}").select("id", spans.resolve(F.col("e")).alias("k")).collect()
    assert {r.id: [(k.start, k.end, k.confidence) for k in r.k] for r in out} == {i: [(h.start, h.end, h.confidence) for h in disjoint(c)] for i, c in enumerate(cases)}


def test_column_checks_equal_the_scanner(spark):
    text = "🔑 123-45-6789 GB82 WEST 1234 5698 7654 32 4111 1111 1111 1111 10.0.0.1 v1.2.3.4 born 3/4/1990 12 Oak Street; 000-12-3456"
    row = spark.createDataFrame([(text,)], "t string")
    for name, make in (("ssn", native.ssn_spans), ("iban", native.iban_spans), ("card", native.card_spans), ("ip", native.ipv4_spans), ("dob", native.dob_spans), ("address", native.address_spans)):
        assert [(s.start, s.end, s.value) for s in row.select(make(F.col("t")).alias("s")).head().s] == [(h.start, h.end, text[h.start : h.end]) for h in scan.DETECTORS[name](text)], name


def test_evaluation_is_perfect_on_made_up_documents(spark):
    docs = corpus.generate(spark, 5)
    found = docs.select("id", F.explode(Engine(spark, detectors=scan.fixed.ALL_DETECTORS).entities("text")).alias("e")).select("id", "e.*")
    gold = docs.select("id", F.explode("entities").alias("e")).select("id", "e.*")
    out = {r.type: (r.precision, r.recall, r.f1) for r in evaluate.scores(found, gold).collect()}
    assert out.pop("TOTAL") == (1.0, 1.0, 1.0) and set(out.values()) == {(1.0, 1.0, 1.0)}
    clean = evaluate.false_alarms(found, docs.where(F.size("entities") == 0)).collect()
    assert len(clean) == 2 and all(r.alarms == 0 for r in clean)


def test_sql_functions(spark, batch):
    engine, _, _ = batch
    register(spark, engine.vault)
    row = spark.sql("select mask_pii('to bob@example.com') m, restore_pii('⟨email_2⟩') r, size(audit_pii('bob@example.com')) a, luhn_ok('4111111111111111') l, iban_ok('GB82 WEST 1234 5698 7654 32') i, ssn_ok('000-12-3456') s, nanp_ok('212-555-0134') n, size(detect_pii('8.8.8.8')) d").head()
    assert tuple(row) == ("to ⟨EMAIL_2⟩", "bob@example.com", 1, True, True, False, True, 1)
    assert spark.sql("select e.type from values ('a@b.org 8.8.8.8') t(x), lateral pii_entities(x) e").count() == 2


def test_command_line(spark, tmp_path, capsysbinary):
    text, vault, out = tmp_path / "in.txt", str(tmp_path / "vault.json"), tmp_path / "out.txt"
    text.write_bytes("Jane: x@y.org\r\n".encode())
    names = tmp_path / "names"
    names.write_text("# people\nJane\norg: Acme\n")
    assert cli.main(["mask", str(text), "--vault", vault, "-o", str(out), "--names-file", str(names)], spark) == 0
    assert out.read_bytes().decode() == "⟨PERSON_1⟩: ⟨EMAIL_1⟩\r\n"
    assert cli.main(["restore", str(out), "--vault", vault], spark) == 0
    assert capsysbinary.readouterr().out == text.read_bytes()
    assert cli.main(["audit", str(text), "--vault", vault, "--json"], spark) == 1
    assert cli.main(["audit", str(out), "--vault", vault], spark) == 0
    assert cli.main(["mask", vault, "--vault", vault], spark) == 2 and cli.main(["restore", str(text), "--vault", str(tmp_path / "none")], spark) == 2


def test_name_model_says_what_is_missing():
    with pytest.raises(RuntimeError):
        SpacyNames().find("text")


def test_unknown_detectors_are_refused(spark):
    with pytest.raises(ValueError):
        Engine(spark, detectors=["nothing"])
