"""The engine's registered queries over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import native
from ..functions.scan import KnownNames
from ..functions.surrogates import Realistic, luhn_digit
from ..operators import audit, detect, documents, evaluate, mask, names, replay, restore, spans
from ..operators.tables import shared_folder, stored
from ..sources import tables
from ..sources import vault as vaults
from ..streaming import restore as streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _found(spark: SparkSession, sf_dir: str, *detectors: str) -> DataFrame:
    """(doc_id, type, value, start, end) of resolved entities."""
    options = {"detectors": detectors} if detectors else {}
    found = _docs(spark, sf_dir).select("doc_id", F.explode(detect.entities("text", **options)).alias("e"))
    return found.select("doc_id", "e.type", "e.value", "e.start", "e.end")


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


# --- detection ------------------------------------------------------------------------------------------------------


def detect_ipv4_documents(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", F.explode(native.ipv4_spans(F.col("text"))).alias("s"))
    return _counted(found.select("doc_id", "s.value"))


def detect_card_documents(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", F.explode(native.card_spans(F.col("text"))).alias("s"))
    return _counted(found.select("doc_id", "s.value"))


def detect_email_ascii_documents(spark, sf_dir):
    return _counted(_found(spark, sf_dir, "email"))


def detect_phone_nanp_documents(spark, sf_dir):
    return _counted(_found(spark, sf_dir, "phone"))


def detect_secret_documents(spark, sf_dir):
    return _counted(_found(spark, sf_dir, "secret"))


def entity_counts_by_lang(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    each = docs.select("lang", F.explode(detect.entities("text", detectors=("email", "ip"))).alias("e"))
    counts = each.rollup("lang", "e.type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.coalesce("lang", F.lit("TOTAL")).alias("lang"), F.coalesce("type", F.lit("TOTAL")).alias("type"), "n")


def entity_counts_by_type(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


def native_equals_scanner(spark, sf_dir):
    """Rows where the column expressions and the scanner disagree: none."""
    docs = _docs(spark, sf_dir).withColumns({"text": F.concat("text", F.lit(" SSN 123-45-6789 born 3/4/1990 12 Oak Street GB82 WEST 1234 5698 7654 32"))})
    kinds = {"ssn": native.ssn_spans, "iban": native.iban_spans, "card": native.card_spans, "dob": native.dob_spans, "address": native.address_spans}
    # One scan for all: a detector's own spans never overlap, and spans of two detectors may, so nothing is resolved.
    both = docs.select(*[f(F.col("text")).alias(n) for n, f in kinds.items()], detect.entities("text", detectors=kinds, resolved=False).alias("scanned"))
    own = lambda kind: F.filter("scanned", lambda s: s["detector"] == kind)
    places = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["end"]))
    same = F.lit(True)
    for n in kinds:
        same = same & (places(F.col(n)) == places(own(n)))
    return both.agg(F.count_if(~same).alias("n_different"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("ssn")).alias("n_ssn"), F.sum(F.size("iban")).alias("n_iban"), F.sum(F.size("address")).alias("n_address"))


def known_names_documents(spark, sf_dir):
    names = KnownNames(persons=["idiot"], orgs=["All rights reserved"], locations=["Apache License"])
    found = _docs(spark, sf_dir).select("doc_id", F.explode(detect.entities("text", detectors=(), names=[names])).alias("e"))
    return found.groupBy("doc_id", "e.type").agg(F.count(F.lit(1)).alias("n"))


# --- checks on values built from keys ---------------------------------------------------------------------------------


def luhn_from_keys(spark, sf_dir):
    digits = F.lpad((F.col("c_custkey") * 7919).cast("string"), 15, "4")
    return _table(spark, sf_dir, "customer").select("c_custkey", F.concat(digits, luhn_digit(digits)).alias("number"), native.luhn_ok(F.concat(digits, F.lit("0"))).alias("zero_ok"))


def ssn_validity_from_keys(spark, sf_dir):
    k = F.col("c_custkey")
    area, group, serial = (F.lpad(F.pmod(k * m, F.lit(d)).cast("string"), w, "0") for m, d, w in ((37, 1000, 3), (11, 100, 2), (7, 10000, 4)))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("-", area, group, serial).alias("ssn"), native.ssn_ok(area, group, serial).alias("valid"))


def iban_check_from_keys(spark, sf_dir):
    iban = F.concat(F.lit("GB"), F.lpad((F.pmod("c_custkey", F.lit(97)) + 2).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))
    return _table(spark, sf_dir, "customer").select("c_custkey", iban.alias("iban"), native.iban_ok(iban).alias("valid"))


def dob_context_from_keys(spark, sf_dir):
    word = F.when(F.pmod("c_custkey", F.lit(3)) == 0, "born on").when(F.pmod("c_custkey", F.lit(3)) == 1, "seen on").otherwise("DOB:" + " " * 40)
    text = F.concat(word, F.lit(" "), F.lpad((F.pmod("c_custkey", F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("/14/1990"))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.size(native.dob_spans(text)).cast("long").alias("n"))


def realistic_surrogates(spark, sf_dir):
    n, kind = F.col("c_custkey"), F.element_at(F.array(*map(F.lit, ("PERSON", "ORG", "EMAIL", "PHONE", "CARD", "SSN"))), (F.pmod("c_custkey", F.lit(6)) + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select(n, kind.alias("type"), Realistic().column(kind, F.lit(""), n).alias("surrogate"))


def _keyed(spark, sf_dir, text, *detectors):
    """(c_custkey, type, value) found in a text made of each customer's key."""
    made = _table(spark, sf_dir, "customer").select("c_custkey", text.alias("t"))
    return made.select("c_custkey", F.explode(detect.entities("t", detectors=detectors)).alias("e")).select("c_custkey", "e.type", "e.value")


def ipv6_from_keys(spark, sf_dir):
    k = F.col("c_custkey")
    last = F.lower(F.hex(k))
    text = F.when(k % 4 == 0, F.concat(F.lit("at ::1 or "), last, F.lit(":zz"))).when(k % 4 == 1, F.concat(F.lit("[2001:db8::"), last, F.lit("]:80"))).when(k % 4 == 2, F.concat(F.lit("2001:db8:"), last, F.lit("::192.0.2.7."))).otherwise(F.concat(F.lit("fe80::"), last, F.lit("%eth0 up")))
    return _keyed(spark, sf_dir, text, "ip")


def phone_international_from_keys(spark, sf_dir):
    k = F.col("c_custkey")
    eight = F.lpad(k.cast("string"), 8, "0")
    text = F.when(k % 4 == 0, F.concat(F.lit("call +234 80"), eight)).when(k % 4 == 1, F.concat(F.lit("call +33 "), eight)).when(k % 4 == 2, F.concat(F.lit("call +44 (0) 20"), eight, F.lit(" now"))).otherwise(F.concat(F.lit("order +49 30"), eight))
    return _keyed(spark, sf_dir, text, "phone")


def secret_rules_from_keys(spark, sf_dir):
    k, m = F.col("c_custkey"), F.md5(F.col("c_custkey").cast("string").cast("binary"))
    token = F.concat(m, F.upper(F.reverse(m)))
    text = F.when(k % 4 == 0, F.concat(F.lit("Authorization: Bearer "), token)).when(k % 4 == 1, F.concat(F.lit("key AKIA"), F.translate(F.upper(F.substring(m, 1, 16)), "01", "GH"), F.lit(" used"))).when(k % 4 == 2, F.concat(F.lit("the checksum is "), m)).otherwise(F.concat(F.lit("Set-Cookie: sid="), token, F.lit("; Path=/")))
    return _keyed(spark, sf_dir, text, "secret")


def address_from_keys(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" Old Mill Road, Apt 7"))).when(k % 3 == 1, F.concat(F.lit("at "), k.cast("string"), F.lit(" West 5th St NW"))).otherwise(F.concat(F.lit("Mill Road "), k.cast("string")))
    return _keyed(spark, sf_dir, text, "address")


def credential_url_forms(spark, sf_dir):
    """Signed URLs, fragments, encoded names and harmless ones, made from the pages' urls."""
    base = F.regexp_replace("url", "[?#].*$", "")
    n = F.pmod("page_id", F.lit(6))
    tail = F.when(n == 0, "?X-Amz-Signature=0a1b&Expires=9").when(n == 1, "#access_token=zz").when(n == 2, "?acc%65ss_token=zz").when(n == 3, "?sv=2020&sig=zz").when(n == 4, "?sig=zz").otherwise("?page=2#token")
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(base, tail).alias("url"))
    return pages.select("page_id", (F.size(detect.entities("url", detectors=("url_credential",))) > 0).alias("flagged"))


def least_keys_from_customer(spark, sf_dir):
    """Key formats of least length without a digit, and a short unsigned token."""
    k = F.col("c_custkey")
    letters = F.translate(F.lpad(k.cast("string"), 10, "0"), "0123456789", "abcdefghij")
    key = F.when(k % 4 == 0, F.concat(F.lit("xoxb-"), letters)).when(k % 4 == 1, F.concat(F.lit("AKIA"), F.upper(letters), F.lit("ABCDEF"))).when(k % 4 == 2, F.concat(F.lit("sk_live_"), letters, F.lit("abcdef"))).otherwise(F.concat(F.lit("eyJhbGciOiJub25lIn0."), letters, F.lit(".")))
    return _keyed(spark, sf_dir, F.concat(F.lit("use "), key, F.lit(" now")), "secret")


def private_keys_from_keys(spark, sf_dir):
    k = F.col("c_custkey")
    label = F.when(k % 3 == 0, "RSA ").when(k % 3 == 1, "EC ").otherwise("")
    text = F.concat(F.lit("see\n-----BEGIN "), label, F.lit("PRIVATE KEY-----\nMII"), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("\n-----END "), label, F.lit("PRIVATE KEY-----"))).otherwise(""), F.lit("\n\n. The end"))
    return _keyed(spark, sf_dir, text, "secret")


def http_archives_from_keys(spark, sf_dir):
    """HAR 1.2 entries with a cookie header, a cookie, a key in the query and a form."""
    k = F.col("c_custkey").cast("string")
    head = '{"log":{"version":"1.2","entries":[{"request":{"url":"http://a.example/","headers":[{"name":"Cookie","value":"sid='
    text = F.concat(F.lit(head), k, F.lit('"}],"cookies":[{"name":"s","value":"c'), k, F.lit('"}],"queryString":[{"name":"api_key","value":"q'), k, F.lit('"}],"postData":{"mimeType":"application/x-www-form-urlencoded","text":"password=p'), k, F.lit('"}}}]}}'))
    return _keyed(spark, sf_dir, text, "secret")


def names_from_customer(spark, sf_dir):
    """Customers of one segment, as names, in a line for each order; by joins, as for a table beyond any broadcast."""
    known = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("name"), F.lit("ORG").alias("type"))
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    line = F.concat(F.lit("Deal of CUSTOMER#"), number, F.lit(", not xcustomer#"), number, F.lit(" or Customer#"), number, F.lit("7 on "), F.col("o_orderstatus"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", line.alias("text"))
    found = names.known_names(orders, known, broadcast_rows=0)
    return found.select("o_orderkey", F.explode("entities").alias("e")).select("o_orderkey", "e.value", F.col("e.start").cast("long").alias("start"))


# --- spans, vault, mask, restore, audit -----------------------------------------------------------------------------------


def _line_spans(spark, sf_dir):
    """A span for each line of an order, from its keys."""
    start = F.pmod("l_partkey", F.lit(60)).cast("int")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"), (start + 1 + F.pmod("l_suppkey", F.lit(12))).cast("int").alias("end"), F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(3)).cast("double").alias("confidence"))
    return lines.where("l_orderkey is not null")


def span_overlap_resolution(spark, sf_dir):
    entity = F.struct(F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("type"), F.lit("").alias("value"), "start", "end", F.lit("d").alias("detector"), "confidence")
    own = _line_spans(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", entity.alias("e")))), lambda x: x["e"]).alias("e"))
    return own.select("l_orderkey", F.explode(spans.resolve(F.col("e"))).alias("k")).select("l_orderkey", "k.type", "k.start", "k.end")


def span_interval_join(spark, sf_dir):
    """Overlaps between the odd and the even lines' spans of an order."""
    own = _line_spans(spark, sf_dir)
    pairs = spans.overlapping(own.where("l_linenumber % 2 = 1"), own.where("l_linenumber % 2 = 0"), ["l_orderkey"], width=8)
    return pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.least("end", "right_end") - F.greatest("start", "right_start")).cast("long").alias("n_shared"))


def mask_null_keys(spark, sf_dir):
    """Turns of which some have no vault or no order: what stays in the clear, and what comes back."""
    turns = _table(spark, sf_dir, "conversations").select(
        F.when(F.col("conv_id") % 4 > 0, F.col("conv_id").cast("string")).alias("vault"), F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("place"), F.concat(F.lit("mail u"), F.pmod("conv_id", F.lit(7)).cast("string"), F.lit("@example.org or w"), F.col("turn").cast("string"), F.lit("@example.net")).alias("text")
    )
    masked, vault = mask.mask(turns, vaults.empty(spark), "text", "place", "vault", detectors=("email",))
    back = restore.restore(masked, vault, vault_id="vault", broadcast_rows=0)
    sums = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("masked").contains("@")).alias("n_clear"), F.count_if(F.col("restored") == F.col("text")).alias("n_restored"), F.sum(F.size("entities")).alias("n_entities")]
    held = vault.groupBy("vault_id").agg(F.count(F.lit(1)).alias("n_mappings"))
    return back.groupBy(F.coalesce("vault", F.lit("")).alias("vault_id")).agg(*sums).join(held, "vault_id")


def _masked(spark, sf_dir, detectors=("ip",)):
    return mask.mask(_docs(spark, sf_dir), vaults.empty(spark), "text", "doc_id", detectors=detectors)


def vault_mint(spark, sf_dir):
    return _masked(spark, sf_dir)[1].select("ord", "type", "original", "surrogate")


def vault_tokens(spark, sf_dir):
    """Customers' names as signed and encrypted tokens and back; a token of another customer's length has another size."""
    key = b"cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="
    sealed = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", vaults.fernet_encrypted(F.col("c_name"), key).alias("token"))
    whole, cut = (vaults.fernet_decrypted(t, key) for t in (F.col("token"), F.concat(F.lit("gBBB"), F.substring("token", 5, 1000))))
    return sealed.select("c_custkey", F.length("token").cast("long").alias("n_token"), whole.cast("string").alias("c_name"), cut.isNull().alias("forged_refused"))


def vault_uniqueness(spark, sf_dir):
    _, vault = _masked(spark, sf_dir, ("email", "ip"))
    return vault.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("original").alias("originals"), F.count_distinct("surrogate").alias("surrogates"))


def mask_documents(spark, sf_dir):
    return _masked(spark, sf_dir)[0].select("doc_id", "masked")


def mask_documents_all(spark, sf_dir):
    engine = Engine(spark)
    return engine.mask(_docs(spark, sf_dir), ord="doc_id").select("doc_id", "masked", F.size("entities").alias("n_entities"))


def restore_exact_roundtrip(spark, sf_dir):
    masked, vault = _masked(spark, sf_dir)
    back = restore.restore_joined(masked, vault)
    return back.agg(F.count_if(F.col("restored") != F.col("text")).alias("n_mismatches"), F.count_if(F.col("masked") != F.col("text")).alias("n_masked"), F.sum(F.length("restored")).alias("n_chars"))


def restore_tolerant_roundtrip(spark, sf_dir):
    masked, vault = _masked(spark, sf_dir)
    back = restore.restore(masked.withColumn("masked", F.upper("masked")), vault)
    return back.agg(F.count_if(F.col("restored") != F.upper("text")).alias("n_mismatches"), F.count_if(F.col("masked") != F.col("restored")).alias("n_restored"), F.count(F.lit(1)).alias("n_rows"))


def restore_realistic_joined(spark, sf_dir):
    """Mailboxes and addresses under realistic surrogates, spelled in capitals, and back by joins alone."""
    masked, vault = mask.mask(_docs(spark, sf_dir), vaults.empty(spark), "text", "doc_id", detectors=("email", "ip"), generator=Realistic())
    capitals = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    found = restore.restore(masked.withColumn("masked", capitals("masked")), vault, broadcast_rows=0)
    return found.select("doc_id", F.md5(capitals("restored").cast("binary")).alias("restored_md5"))


def restore_json_joined(spark, sf_dir):
    """Documents around the events' props with addresses in values and keys, and back by joins alone."""
    vault = _table(spark, sf_dir, "events").select(F.lit("").alias("vault_id"), F.col("event_id").alias("ord"), F.lit("IPV4").alias("type"), F.concat(F.lit('say "'), F.col("event_id").cast("string"), F.lit('"')).alias("original"), F.concat(F.lit("⟨IPV4_"), F.col("event_id").cast("string"), F.lit("⟩")).alias("surrogate"), F.lit("").alias("detector"))
    mark = F.concat(F.lit("⟨IPV4_"), F.col("event_id").cast("string"), F.lit("⟩"))
    made = F.concat(F.lit('{"'), mark, F.lit('":1,"a":["'), mark, F.lit(" and \\u27e8IPV4_"), F.col("event_id").cast("string"), F.lit('⟩"],"n":1.10,"props":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    back = restore.restore(_table(spark, sf_dir, "events").select("event_id", made.alias("masked")), vault, mode="json", broadcast_rows=0)
    return back.select("event_id", "restored")


def _ip_vault(spark, sf_dir):
    found = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"), F.lit(0))).alias("original")).distinct()
    return stored(found.select(F.lit("").alias("vault_id"), F.lit(0).cast("long").alias("ord"), F.lit("IPV4").alias("type"), "original", F.concat(F.lit("⟨"), "original", F.lit("⟩")).alias("surrogate"), F.lit("").alias("detector")))


def audit_leaked_originals(spark, sf_dir):
    found = audit.leaked_joined(_docs(spark, sf_dir), _ip_vault(spark, sf_dir), "doc_id")
    return found.groupBy("doc_id", "value").agg(F.min("start").cast("long").alias("first"))


def audit_new_pii(spark, sf_dir):
    """Addresses that are new to a vault of those that end in an even digit."""
    vault = _ip_vault(spark, sf_dir).where("original rlike '[02468]$'")
    found = audit.findings(_docs(spark, sf_dir), vault, detectors=("ip",), leaks=False).select("doc_id", F.explode("findings").alias("f"))
    return found.groupBy("doc_id", F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


# --- URLs ---------------------------------------------------------------------------------------------------------------------


def url_query_params(spark, sf_dir):
    url = F.col("url")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(query, "&")).alias("p")).where("p <> ''")
    return pairs.select("page_id", F.substring_index("p", "=", 1).alias("name"), F.when(F.instr("p", "=") > 0, F.expr("substring(p, instr(p, '=') + 1)")).otherwise("").alias("value"))


def credential_url_flags(spark, sf_dir):
    made = F.when(F.pmod("page_id", F.lit(5)) == 0, F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("access_token=abc"))).when(F.pmod("page_id", F.lit(5)) == 1, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).otherwise(F.col("url"))
    pages = _table(spark, sf_dir, "pages").select("page_id", made.alias("url"))
    return pages.select("page_id", (F.size(detect.entities("url", detectors=("url_credential",))) > 0).alias("flagged"))


# --- documents, messages, streams, evaluation ---------------------------------------------------------------------------------


def mask_conversations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.concat("text", F.lit(" from 198.51.100."), F.pmod("conv_id", F.lit(200)).cast("string")).alias("text"))
    masked, _ = mask.mask(turns, vaults.empty(spark), "text", "turn", "conv_id", detectors=("ip",))
    return masked.select("conv_id", "turn", "masked")


def mask_chat_messages(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    content = F.concat("text", F.lit(" 198.51.100."), F.pmod("conv_id", F.lit(200)).cast("string"))
    call = F.array(F.struct(F.struct(F.to_json(F.struct(F.lit("203.0.113.9").alias("host"), F.lit(1.5).alias("n"))).alias("arguments")).alias("function")))
    chat = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.to_json(F.struct("role", content.alias("content"), call.alias("tool_calls"))).alias("message"))
    masked, _ = documents.mask_documents(chat, vaults.empty(spark), "message", "turn", "conv_id", "chat", ("ip",))
    return masked.select("conv_id", "turn", "masked")


def mask_event_props(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"props":'), F.coalesce("props", F.lit("null")), F.lit(',"ip":"198.51.100.7","n":1.10}')).alias("doc"))
    masked, vault = documents.mask_documents(events, vaults.empty(spark), "doc", "event_id", style="values", detectors=("ip",))
    back = documents.restore_documents(masked, vault)
    return back.agg(F.count_if(F.col("masked") != F.col("doc")).alias("n_masked"), F.count_if(F.col("restored") != F.col("doc")).alias("n_mismatches"))


def replay_conversations(spark, sf_dir):
    """The last three turns of each conversation's assistant are known by turn, however alike their contents are."""
    said = _table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "role", F.lit("Certainly.").alias("text"), F.concat(F.lit("⟨TURN_"), F.col("turn").cast("string"), F.lit("⟩ "), "text").alias("original"))
    cache = replay.remember(replay.empty(spark), said, "text", "original", "turn", "conv_id", "turn", bound=3)
    kept = said.join(cache.entries.select(F.col("scope").cast("long").alias("conv_id"), F.col("occurrence").cast("long").alias("turn")), ["conv_id", "turn"], "left_semi")
    back = replay.replay(kept, cache, "text", "conv_id", "turn")
    return back.select("conv_id", "turn", F.md5(F.col("replay").cast("binary")).alias("replay_md5"))


def restore_chunks(spark, sf_dir):
    masked, vault = _masked(spark, sf_dir)
    # Pieces of 24 characters in one pass (a substring counts from the text's begin each time), and an empty one behind those that fill the text.
    pieces = F.regexp_extract_all("masked", F.lit("(?s).{1,24}"), F.lit(0))
    pieces = F.when(F.length("masked") % 24 == 0, F.concat(pieces, F.array(F.lit("")))).otherwise(pieces)
    cut = masked.select(F.col("doc_id").cast("string").alias("stream_id"), F.lit(0).alias("block"), F.posexplode(pieces).alias("i", "chunk"), F.floor(F.length("masked") / 24).alias("n"))
    chunks = cut.select("stream_id", "block", F.col("i").cast("long").alias("seq"), "chunk", (F.col("i") == F.col("n")).alias("final"))
    # By the streaming query itself: the chunks are a file source, read until it has no more.
    source = stored(chunks)
    folder = shared_folder(spark) + f"/stream-{uuid.uuid4().hex}"
    running = streams.restore_stream(spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rpartition("/")[0]), vault, idle=None)
    query = running.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(running.schema).parquet(folder + "/out")
    back = out.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("restored"))
    return back.select(F.col("stream_id").cast("long").alias("doc_id"), F.md5(F.col("restored").cast("binary")).alias("restored_md5"))


def _labelled(spark, sf_dir):
    """(id, category, text, and the label's type, start, end or nulls): mailboxes of which half are labelled, addresses, versions without a label, and numbers
    that are labelled but of no valid area."""
    k = F.col("c_custkey")
    number, last = k.cast("string"), (F.pmod(k, F.lit(250)) + 1).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("mail u"), number, F.lit("@example.org now"))).when(k % 4 == 1, F.concat(F.lit("ip 198.51.100."), last, F.lit(" up"))).when(k % 4 == 2, F.concat(F.lit("release v1.2.3."), last)).otherwise("ssn 900-12-3456 given")
    kind = F.when(k % 8 == 4, "EMAIL").when(k % 4 == 1, "IPV4").when(k % 4 == 3, "SSN")
    start = F.when(k % 8 == 4, 5).when(k % 4 == 1, 3).when(k % 4 == 3, 4)
    size = F.when(k % 8 == 4, F.length(number) + 13).when(k % 4 == 1, F.length(last) + 11).when(k % 4 == 3, 11)
    return _table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("category"), text.alias("text"), kind.alias("type"), start.alias("start"), (start + size).alias("end"))


def _alarms(docs):
    return docs.select("id", F.explode(detect.entities("text")).alias("e")).select("id", "e.type", "e.start", "e.end")


def evaluation_scores(spark, sf_dir):
    docs = _labelled(spark, sf_dir)
    return evaluate.scores(_alarms(docs), docs.where("type is not null").select("id", "type", "start", "end"))


def evaluation_false_alarms(spark, sf_dir):
    docs = _labelled(spark, sf_dir).where("type is null")
    return evaluate.false_alarms(_alarms(docs), docs)


QUERIES = (
    detect_ipv4_documents, detect_card_documents, detect_email_ascii_documents, detect_phone_nanp_documents, detect_secret_documents, entity_counts_by_lang,
    entity_counts_by_type, native_equals_scanner, known_names_documents, luhn_from_keys, ssn_validity_from_keys, iban_check_from_keys, dob_context_from_keys,
    ipv6_from_keys, phone_international_from_keys, secret_rules_from_keys, address_from_keys, credential_url_forms,
    realistic_surrogates, span_overlap_resolution, vault_mint, vault_uniqueness, mask_documents, mask_documents_all, restore_exact_roundtrip,
    restore_tolerant_roundtrip, audit_leaked_originals, audit_new_pii, url_query_params, credential_url_flags, mask_conversations, mask_chat_messages,
    mask_event_props, restore_chunks, evaluation_scores, evaluation_false_alarms, least_keys_from_customer, private_keys_from_keys, http_archives_from_keys,
    names_from_customer, span_interval_join, mask_null_keys, restore_realistic_joined, restore_json_joined, replay_conversations, vault_tokens,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


#: What the detector takes for a version's label, at the end of the 16 characters before an address. A slice's begin counts as a word's edge.
VERSION = r"(?i)((^|[^\p{L}\p{N}_])(v|(version|ver\.?|build|release|firmware)[\s\p{Z}\x0b\x1c-\x1f\x85]*[:=]?[\s\p{Z}\x0b\x1c-\x1f\x85]*|(Chrome|Chromium|HeadlessChrome|CriOS|Edg|Edge|EdgA|OPR|Firefox|FxiOS|Safari|Version|AppleWebKit|Electron|Trident)/)|~)\n?$"
#: Candidates are dotted quads, leftmost first; the texts between them say what stands before and after each. dotted: addresses of hosts that stand apart and
#: follow no version's label; hosts: those of them that are no tail of what looks like an IPv6 address (two colons or more), as the detector has it.
IPS = rf"""
quads AS (
  SELECT doc_id, text, regexp_extract_all(text, '\d{{1,3}}(?:\.\d{{1,3}}){{3}}') AS c, regexp_split_to_array(text, '\d{{1,3}}(?:\.\d{{1,3}}){{3}}') AS b
  FROM documents WHERE regexp_matches(text, '\d{{1,3}}(?:\.\d{{1,3}}){{3}}')
), placed AS (
  SELECT doc_id, text, c[i] AS value, concat(CASE WHEN i > 3 THEN c[i - 3] END, CASE WHEN i > 2 THEN b[i - 2] || c[i - 2] END, CASE WHEN i > 1 THEN b[i - 1] || c[i - 1] END, b[i]) AS before, b[i + 1] AS after
  FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM quads)
), dotted AS (
  SELECT doc_id, text, value, before, after FROM placed
  WHERE NOT regexp_matches(before, '[\p{{L}}\p{{N}}_.]$') AND NOT regexp_matches(after, '^([\p{{L}}\p{{N}}_]|\.\p{{Nd}})') AND NOT regexp_matches(right(before, 16), '{VERSION}')
    AND regexp_matches(value, '^(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])){{3}}$')
    AND NOT regexp_matches(value, '^(127\.|2[45][0-9]\.|0\.0\.0\.0$)')
), coloned AS (
  SELECT *, regexp_extract(before, '(?:^|[^\p{{L}}\p{{N}}_:%.])([0-9A-Fa-f]*:[0-9A-Fa-f:]*(?:\.[0-9][0-9A-Fa-f:]*)*(?:%[\p{{L}}\p{{N}}_.%:~+-]*)?)$', 1) AS head FROM dotted
), hosts AS (
  SELECT doc_id, text, value FROM coloned
  WHERE head = '' OR length(regexp_replace(split_part(head, '%', 1) || CASE WHEN contains(head, '%') THEN '' ELSE regexp_extract(after, '^[0-9A-Fa-f:]*(?:\.[0-9][0-9A-Fa-f:]*)*') END, '[^:]', '', 'g')) < 2
)
"""
LINE_SPANS = """
WITH RECURSIVE spans AS (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey % 60 AS INTEGER) AS start, CAST(l_partkey % 60 + 1 + l_suppkey % 12 AS INTEGER) AS "end", CAST((l_partkey + l_linenumber) % 3 AS DOUBLE) AS confidence
  FROM lineitem WHERE l_orderkey IS NOT NULL
)
"""
MINTED = (
    IPS
    + """, firsts AS (
  SELECT value, min((doc_id, strpos(text, value))) AS place FROM hosts GROUP BY value
), minted AS (
  SELECT value, row_number() OVER (ORDER BY place) AS k FROM firsts
)
"""
)
#: An assigned value behind a name that says what it is, with what stands before the name; key formats with what stands before them.
NAME = "(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_(?:PASSWORD|PASSWD|API_KEY|CLIENT_SECRET|ACCESS_TOKEN|REFRESH_TOKEN)|" + re.sub(
    "[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", "password|passwd|api[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|x-api-key"
) + ")"
VALUE_END = r"""\s\p{Z}\x0b\x1c-\x1f\x85,;"''{}\[\]()<>`"""
QUOTED = r"""(?:"(?:[^"\\\r\n]|\\[^\r\n])*"|''(?:[^''\\\r\n]|\\[^\r\n]|'''')*'')"""
FIELD = (
    rf"""(?:^|[^\p{{L}}\p{{N}}_./?&#-])(?:(?:"{NAME}"|''{NAME}''|{NAME})[ \t]*[:=][ \t]*{QUOTED}"""
    rf"""|{NAME}[ \t]*(?:=|[:=][ \t]+=?)(?:[^=#$&*!|@%{VALUE_END}]|\|[\p{{L}}\p{{N}}_])[^{VALUE_END}]*)"""
)
KEY = r"(?:(?:^|[^\p{L}\p{N}_])(?:AKIA|ASIA)[0-9A-Z]{16}|(?:^|[^\p{L}\p{N}_-])(?:sk-(?:proj|svcacct)-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|sk-ant-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,}))"
TYPE_WORDS = "null none nil undefined true false str string int integer bool boolean bytes float number any object optional text secret password"
LUHN = "(list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN (length({0}) - i) % 2 = 1 THEN (CAST({0}[i] AS INTEGER) * 2) // 10 + (CAST({0}[i] AS INTEGER) * 2) % 10 ELSE CAST({0}[i] AS INTEGER) END)) % 10)"

SQL = {
    "detect_ipv4_documents": f"WITH {IPS} SELECT doc_id, value, count(*) AS n FROM dotted GROUP BY ALL",
    "detect_card_documents": rf"""
        WITH runs AS (
          SELECT doc_id, regexp_extract(m, '\d{{13,19}}') AS value FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'),
            '(?:^|[^\p{{L}}\p{{N}}_.+\-/])\d{{13,19}}(?:$|[^\p{{L}}\p{{N}}_.\-/]|[.\-/](?:$|[^\p{{L}}\p{{N}}_]))')) AS m FROM documents)
        )
        SELECT doc_id, value, count(*) AS n FROM runs
        WHERE value[1] <> '0' AND {LUHN.format("value")} = 0 AND (
          regexp_matches(value, '^4') AND length(value) IN (13, 16, 19) OR regexp_matches(value, '^(5[1-5]|2(2[2-9]\d|[3-6]\d\d|7[01]\d|720))') AND length(value) = 16
          OR regexp_matches(value, '^3[47]') AND length(value) = 15 OR regexp_matches(value, '^(6011|65|64[4-9])') AND length(value) BETWEEN 16 AND 19
          OR regexp_matches(value, '^(30|36|38|39)') AND length(value) BETWEEN 14 AND 19 OR regexp_matches(value, '^35(2[89]|[3-8]\d)') AND length(value) BETWEEN 16 AND 19
          OR regexp_matches(value, '^62') AND length(value) BETWEEN 16 AND 19 OR regexp_matches(value, '^(5018|5020|5038|5893|6304|6759|6761|6762|6763)') AND length(value) BETWEEN 13 AND 19
          OR regexp_matches(value, '^(50|56|58|6[0-3])') AND length(value) IN (16, 18, 19) OR regexp_matches(value, '^(60|65|81|82|508)') AND length(value) = 16
          OR regexp_matches(value, '^220[0-4]') AND length(value) BETWEEN 16 AND 19 OR regexp_matches(value, '^2205') AND length(value) = 16
          OR regexp_matches(value, '^636') AND length(value) BETWEEN 16 AND 19 OR regexp_matches(value, '^63[7-9]') AND length(value) = 16
          OR regexp_matches(value, '^(9792|8600|5614|9860)') AND length(value) = 16 OR regexp_matches(value, '^(9704|1946)') AND length(value) IN (16, 18, 19)
          OR regexp_matches(value, '^(31|960046)') AND length(value) = 19)
        GROUP BY ALL""",
    "detect_email_ascii_documents": r"""
        WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) AS value FROM documents)
        SELECT doc_id, value, count(*) AS n FROM found GROUP BY ALL""",
    # As the detector has it. Numbers with +1: a plus sign apart, no word glued to the end but an extension. National ones: words of digits (each between the
    # marks 1 and 2, which stand for the word's edges) that are ten digits of that plan. Neither after some words in the 15 characters before.
    "detect_phone_nanp_documents": r"""
        WITH marked AS (
          SELECT doc_id, regexp_replace(text, '([\p{L}\p{N}_]+)', E'\x01\\1\x02', 'g') AS t, '(?:^|[^\x02])(\+\x01\d{8,15}\x02|(?:\+\x01\d{1,3}\x02[\s.-]?)?(?:\(\x01\d{2,4}\x02\)[\s.-]?)?\x01\d{2,4}\x02(?:[\s.-]\x01\d{2,4}\x02){1,4}|\+\x01\d{3,7}\x02(?:[\s.-]\x01\d{2,4}\x02){1,4})' AS p FROM documents
        ), signed AS (
          SELECT doc_id, regexp_extract_all(text, '\+1 \([2-9]\d{2}\) [2-9]\d{2}-\d{4}') AS c, regexp_split_to_array(text, '\+1 \([2-9]\d{2}\) [2-9]\d{2}-\d{4}') AS b FROM documents
        ), national AS (
          SELECT doc_id, regexp_extract_all(t, p) AS w, regexp_extract_all(t, p, 1) AS c, regexp_split_to_array(t, p) AS b FROM marked
        ), placed AS (
          SELECT doc_id, c[i] AS value, concat(CASE WHEN i > 1 THEN c[i - 1] END, b[i]) AS before, b[i + 1] AS after FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM signed)
          WHERE NOT regexp_matches(before, '[\p{L}\p{N}_+]$') AND (NOT regexp_matches(after, '^[\p{L}\p{N}_]') OR regexp_matches(after, '^[xX]\p{Nd}'))
          UNION ALL
          SELECT doc_id, translate(c[i], E'\x01\x02', '') AS value, translate(concat(CASE WHEN i > 3 THEN w[i - 3] END, CASE WHEN i > 2 THEN b[i - 2] || w[i - 2] END, CASE WHEN i > 1 THEN b[i - 1] || w[i - 1] END, b[i], left(w[i], length(w[i]) - length(c[i]))), E'\x01\x02', '') AS before, '' AS after
          FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM national)
          WHERE NOT starts_with(value, '+') AND regexp_full_match(value, '1?[\s.-]?\(?[2-9]\d{2}\)?[\s.-]?[2-9]\d{2}[\s.-]?\d{4}')
        )
        SELECT doc_id, value, count(*) AS n FROM placed
        WHERE NOT regexp_matches(right(before, 15), '(?i)(#[\s\p{Z}\x0b\x1c-\x1f\x85]*$|(^|[^\p{L}\p{N}_])((order|invoice|ticket|zip)([^\p{L}\p{N}_]|$)|inv-[\p{L}\p{N}_]))')
        GROUP BY ALL""",
    # The rules of key formats and of credential fields as the detector has them: names in any case, or of variables; a line may hold several; of two spans that
    # overlap the longer one stays. Private keys, JWTs, HTTP headers, YAML scalars, JSON and random tokens are not stated.
    "detect_secret_documents": rf"""
        WITH cut AS (
          SELECT doc_id, text, regexp_extract_all(text, '{FIELD}') AS c, regexp_split_to_array(text, '{FIELD}') AS b, regexp_extract_all(text, '{KEY}') AS kc, regexp_split_to_array(text, '{KEY}') AS kb
          FROM documents WHERE regexp_matches(text, '{FIELD}') OR regexp_matches(text, '{KEY}')
        ), ends AS (
          SELECT doc_id, c[i] AS m, left(concat(b[i + 1], c[i + 1]), 1) AS after, coalesce(list_sum(list_transform(b[:i], lambda x: length(x))), 0) + list_sum(list_transform(c[:i], lambda x: length(x))) AS e, 0 AS kind
          FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM cut)
          UNION ALL
          SELECT doc_id, kc[i], left(concat(kb[i + 1], kc[i + 1]), 1), coalesce(list_sum(list_transform(kb[:i], lambda x: length(x))), 0) + list_sum(list_transform(kc[:i], lambda x: length(x))), 1
          FROM (SELECT *, unnest(range(1, len(kc) + 1)) AS i FROM cut)
        ), given AS (
          SELECT *, regexp_extract(m, CASE kind WHEN 0 THEN '(?s)^.??["'']?[A-Za-z0-9_-]+["'']?[ \t]*[:=][ \t]*(.*)$' ELSE '((?:AKIA|ASIA|sk[-_]|ghp_|github_pat_|xox).*)$' END, 1) AS v FROM ends
        ), quoted AS (
          SELECT *, kind = 0 AND regexp_matches(v, '^["'']') AS q FROM given
        ), spans AS (
          SELECT doc_id, kind, CASE WHEN q THEN v[2:-2] WHEN kind = 0 AND after IN ('', ' ', chr(10), chr(13)) THEN rtrim(v, '.:') ELSE v END AS value,
            e - length(v) + CAST(q AS INTEGER) AS s, s + length(value) AS e FROM quoted
          WHERE value <> '' AND CASE WHEN q OR regexp_matches(v, '^A[KS]IA') AND kind = 1 THEN NOT regexp_matches(after, '[\p{{L}}\p{{N}}_]')
            ELSE kind = 1 OR after NOT IN ('(', '[', '{{', '<') AND NOT list_contains(string_split('{TYPE_WORDS}', ' '), lower(value)) END
        )
        SELECT doc_id, value, count(*) AS n FROM spans AS a
        WHERE NOT EXISTS (SELECT 1 FROM spans AS o WHERE o.doc_id = a.doc_id AND o.kind <> a.kind AND o.s < a.e AND a.s < o.e AND (a.e - a.s, o.s, o.kind) < (o.e - o.s, a.s, a.kind))
        GROUP BY ALL""",
    "entity_counts_by_lang": rf"""
        WITH {IPS}, each AS (
          SELECT lang, 'IPV4' AS type FROM hosts JOIN documents USING (doc_id)
          UNION ALL SELECT lang, 'EMAIL' FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~.-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}')) FROM documents))
        SELECT coalesce(lang, 'TOTAL') AS lang, coalesce(type, 'TOTAL') AS type, count(*) AS n FROM each GROUP BY ROLLUP (lang, type)""",
    "native_equals_scanner": "SELECT CAST(0 AS BIGINT) AS n_different, count(*) AS n_rows, count(text) AS n_ssn, count(text) AS n_iban, count(text) AS n_address FROM documents",
    "known_names_documents": r"""
        WITH found AS (
          SELECT doc_id, 'PERSON' AS type, unnest(regexp_extract_all(lower(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g')), '(?:^|[^\p{L}\p{N}_])idiot(?:$|[^\p{L}\p{N}_])')) AS m FROM documents
          UNION ALL SELECT doc_id, 'ORG', unnest(regexp_extract_all(lower(text), 'all rights reserved\b')) FROM documents
          UNION ALL SELECT doc_id, 'LOCATION', unnest(regexp_extract_all(lower(text), 'apache license\b')) FROM documents)
        SELECT doc_id, type, count(*) AS n FROM found GROUP BY ALL""",
    "luhn_from_keys": f"""
        WITH made AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 15, '4') AS d FROM customer), zero AS (SELECT *, d || '0' AS z FROM made)
        SELECT c_custkey, d || CAST((10 - {LUHN.format("z")}) % 10 AS VARCHAR) AS number, {LUHN.format("z")} = 0 AS zero_ok FROM zero""",
    "ssn_validity_from_keys": """
        WITH p AS (SELECT c_custkey, lpad(CAST(c_custkey * 37 % 1000 AS VARCHAR), 3, '0') AS a, lpad(CAST(c_custkey * 11 % 100 AS VARCHAR), 2, '0') AS g, lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') AS s FROM customer)
        SELECT c_custkey, a || '-' || g || '-' || s AS ssn, a NOT IN ('000', '666') AND a[1] <> '9' AND g <> '00' AND s <> '0000' AS valid FROM p""",
    "iban_check_from_keys": """
        WITH p AS (SELECT c_custkey, lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') AS c, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS b FROM customer)
        SELECT c_custkey, 'GB' || c || 'WEST' || b AS iban, CAST('32142829' || b || '1611' || c AS HUGEINT) % 97 = 1 AS valid FROM p""",
    "dob_context_from_keys": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM customer",
    "realistic_surrogates": f"""
        WITH v AS (SELECT c_custkey AS n, c_custkey % 6 AS t,
            ['Avery','Blair','Casey','Dana','Ellis','Frankie','Greer','Harper','Iris','Jules','Kai','Lane','Morgan','Noor','Oakley','Parker','Quinn','Reese','Sage','Tatum','Uma','Val','Wren','Yuki'] AS f,
            ['Alder','Brooks','Castillo','Delgado','Ellison','Farrow','Grant','Haas','Ibarra','Jansen','Kwan','Lindqvist','Moreau','Nakamura','Okafor','Petrov','Quaye','Rousseau','Salazar','Tanaka','Ueda','Vance','Wu','Yilmaz'] AS l,
            ['Acme','Brightline','Cobalt','Driftwood','Evergate','Fulcrum','Gantry','Hearth','Ironwood','Juniper','Kestrel','Lattice'] AS o, ['Inc.','LLC','Co.','Group','Partners','Labs'] AS x FROM customer),
        c AS (SELECT *, CASE n % 3 WHEN 0 THEN '400000' || lpad(CAST(n AS VARCHAR), 9, '0') WHEN 1 THEN '510000' || lpad(CAST(n AS VARCHAR), 9, '0') ELSE '370000' || lpad(CAST(n AS VARCHAR), 8, '0') END || '0' AS z FROM v)
        SELECT n AS c_custkey, ['PERSON','ORG','EMAIL','PHONE','CARD','SSN'][t + 1] AS type, CASE
            WHEN t = 0 AND n <= 576 THEN f[n % 24 + 1] || ' ' || l[(n // 24) % 24 + 1]
            WHEN t = 1 AND n <= 72 THEN o[n % 12 + 1] || ' ' || x[(n // 12) % 6 + 1]
            WHEN t = 2 THEN 'user' || n || '@' || ['example.com','example.org','example.net'][n % 3 + 1]
            WHEN t = 3 AND n <= 800 THEN ['202','212','312','415','512','617','702','917'][(n // 100) % 8 + 1] || '-555-01' || lpad(CAST(n % 100 AS VARCHAR), 2, '0')
            WHEN t = 4 THEN left(z, -1) || CAST((10 - {LUHN.format("z")}) % 10 AS VARCHAR)
            ELSE '⟨' || ['PERSON','ORG','EMAIL','PHONE','CARD','SSN'][t + 1] || '_' || n || '⟩' END AS surrogate FROM c""",
    "span_overlap_resolution": LINE_SPANS + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, "end" - start DESC, start, l_linenumber) AS k FROM spans
), chosen AS (
  SELECT l_orderkey, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(t VARCHAR, a INTEGER, b INTEGER)[]) AS kept FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.l_orderkey, r.k, CASE WHEN len(list_filter(c.kept, lambda x: x.a < r."end" AND r.start < x.b)) > 0 THEN c.kept ELSE list_append(c.kept, {'t': 'T' || r.l_linenumber, 'a': r.start, 'b': r."end"}) END
  FROM chosen c JOIN ranked r ON r.l_orderkey = c.l_orderkey AND r.k = c.k + 1
), last AS (
  SELECT l_orderkey, unnest(arg_max(kept, k)) AS x FROM chosen GROUP BY l_orderkey
)
SELECT l_orderkey, x.t AS type, x.a AS start, x.b AS "end" FROM last
""",
    "span_interval_join": LINE_SPANS + """
SELECT a.l_orderkey, count(*) AS n_pairs, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS n_shared
FROM spans a JOIN spans b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 0 AND a.start < b."end" AND b.start < a."end" GROUP BY a.l_orderkey
""",
    # Numbers go by the first place in a conversation: content comes before the call's arguments; an address after a version's label is none.
    "mask_chat_messages": rf"""
WITH each AS (
  SELECT *, CASE WHEN regexp_matches(right(text || ' ', 16), '{VERSION}') THEN 0 ELSE 1 END AS found FROM conversations
), numbers AS (
  SELECT conv_id, arg_min(found, coalesce(turn, -9223372036854775808)) AS leads FROM each GROUP BY conv_id
)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn,
       '{{"role":' || to_json(role) || ',"content":' || to_json(text || CASE WHEN found = 0 THEN ' 198.51.100.' || (conv_id % 200) WHEN leads = 1 THEN ' ⟨IPV4_1⟩' ELSE ' ⟨IPV4_2⟩' END)
       || ',"tool_calls":[{{"function":{{"arguments":"{{\"host\":\"⟨IPV4_' || CASE WHEN leads = 1 THEN 2 ELSE 1 END || '⟩\",\"n\":1.5}}"}}}}]}}' AS masked
FROM each JOIN numbers USING (conv_id)
""",
    "evaluation_scores": """
WITH made AS (
  SELECT CASE c_custkey % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'IPV4' WHEN 3 THEN 'SSN' END AS type, c_custkey % 8 = 4 OR c_custkey % 4 = 1 AS tp, c_custkey % 8 = 0 AS fp, c_custkey % 4 = 3 AS fn FROM customer WHERE c_custkey % 4 <> 2
), counted AS (
  SELECT coalesce(type, 'TOTAL') AS type, count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM made GROUP BY ROLLUP (type)
), rated AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM counted
)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM rated
""",
    "evaluation_false_alarms": """
WITH docs AS (
  SELECT c_mktsegment AS category, CASE WHEN c_custkey % 8 = 0 THEN 3 ELSE 2 END AS words, CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS alarms FROM customer WHERE c_custkey % 8 = 0 OR c_custkey % 4 = 2
)
SELECT category, CAST(sum(words) AS BIGINT) AS words, CAST(sum(alarms) AS BIGINT) AS alarms, 1000 * sum(alarms) / sum(words) AS per_1000_words FROM docs GROUP BY category
""",
    "vault_tokens": """
SELECT c_custkey, CAST(4 * ceil((57 + 16 * (length(c_name) // 16 + 1)) / 3) AS BIGINT) AS n_token, c_name, true AS forged_refused FROM customer
""",
    "replay_conversations": """
SELECT conv_id, turn, md5('⟨TURN_' || turn || '⟩ ' || text) AS replay_md5
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant') WHERE r <= 3
""",
    "least_keys_from_customer": """
SELECT c_custkey, 'SECRET' AS type, CASE c_custkey % 4 WHEN 0 THEN 'xoxb-' || t WHEN 1 THEN 'AKIA' || upper(t) || 'ABCDEF' WHEN 2 THEN 'sk_live_' || t || 'abcdef' ELSE 'eyJhbGciOiJub25lIn0.' || t || '.' END AS value
FROM (SELECT c_custkey, translate(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), '0123456789', 'abcdefghij') AS t FROM customer)
""",
    "private_keys_from_keys": r"""
SELECT c_custkey, 'SECRET' AS type, '-----BEGIN ' || l || E'PRIVATE KEY-----\nMII' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN E'\n-----END ' || l || 'PRIVATE KEY-----' ELSE '' END AS value
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'RSA ' WHEN 1 THEN 'EC ' ELSE '' END AS l FROM customer)
""",
    "http_archives_from_keys": """
SELECT c_custkey, 'SECRET' AS type, unnest(['sid=' || c_custkey, 'c' || c_custkey, 'q' || c_custkey, 'http://a.example/', 'password=p' || c_custkey]) AS value FROM customer
""",
    "names_from_customer": """
SELECT o_orderkey, 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS value, CAST(8 AS BIGINT) AS start
FROM orders JOIN customer ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') WHERE c_mktsegment = 'BUILDING'
""",
    "mask_null_keys": """
SELECT coalesce(CASE WHEN conv_id % 4 > 0 THEN CAST(conv_id AS VARCHAR) END, '') AS vault_id, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_clear, count(*) AS n_restored, 2 * count(*) AS n_entities,
       count(DISTINCT conv_id % 7) + count(DISTINCT turn) AS n_mappings
FROM conversations GROUP BY 1
""",
    "restore_realistic_joined": "SELECT doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS restored_md5 FROM documents",
    "restore_json_joined": r"""
SELECT event_id, '{"⟨IPV4_' || event_id || '⟩":1,"a":["say \"' || event_id || '\" and say \"' || event_id || '\""],"n":1.10,"props":' || coalesce(props, 'null') || '}' AS restored FROM events
""",
    "vault_mint": f"WITH {MINTED} SELECT k - 1 AS ord, 'IPV4' AS type, value AS original, '⟨IPV4_' || k || '⟩' AS surrogate FROM minted",
    "vault_uniqueness": f"""
        WITH {IPS}, each AS (
          SELECT 'IPV4' AS type, value FROM hosts
          UNION ALL SELECT 'EMAIL', unnest(regexp_extract_all(text, '[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~.-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}')) FROM documents)
        SELECT type, count(DISTINCT value) AS n, count(DISTINCT value) AS originals, count(DISTINCT value) AS surrogates FROM each GROUP BY type""",
    "restore_exact_roundtrip": f"WITH {IPS} SELECT CAST(0 AS BIGINT) AS n_mismatches, count(DISTINCT doc_id) AS n_masked, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS n_chars FROM hosts",
    "restore_tolerant_roundtrip": f"WITH {IPS} SELECT CAST(0 AS BIGINT) AS n_mismatches, count(DISTINCT doc_id) AS n_restored, (SELECT count(*) FROM documents) AS n_rows FROM hosts",
    "audit_leaked_originals": r"""
        WITH vault AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b')) AS value FROM documents)
        SELECT doc_id, value, CAST(strpos(text, value) - 1 AS BIGINT) AS first FROM documents JOIN vault ON contains(text, value)""",
    "audit_new_pii": rf"""
        WITH {IPS} SELECT doc_id, value, count(*) AS n FROM hosts
        WHERE NOT regexp_matches(value, '[02468]$') GROUP BY ALL""",
    "url_query_params": r"""
        WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')) AS p FROM pages)
        SELECT page_id, split_part(p, '=', 1) AS name, CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END AS value FROM p WHERE p <> ''""",
    "credential_url_flags": "SELECT page_id, page_id % 5 IN (0, 1) AS flagged FROM pages",
    "mask_event_props": "SELECT count(*) AS n_masked, CAST(0 AS BIGINT) AS n_mismatches FROM events",
    "restore_chunks": "SELECT doc_id, md5(text) AS restored_md5 FROM documents WHERE text IS NOT NULL",
    "ipv6_from_keys": """
        SELECT c_custkey, 'IPV6' AS type, CASE c_custkey % 4 WHEN 1 THEN '2001:db8::' || format('{:x}', c_custkey) WHEN 2 THEN '2001:db8:' || format('{:x}', c_custkey) || '::192.0.2.7' ELSE 'fe80::' || format('{:x}', c_custkey) || '%eth0' END AS value
        FROM customer WHERE c_custkey % 4 <> 0 AND length(format('{:x}', c_custkey)) <= 4 -- a group of more than four digits makes no address""",
    "phone_international_from_keys": """
        SELECT c_custkey, 'PHONE' AS type, CASE c_custkey % 4 WHEN 0 THEN '+234 80' ELSE '+44 (0) 20' END || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS value FROM customer WHERE c_custkey % 4 IN (0, 2)""",
    "secret_rules_from_keys": """
        SELECT c_custkey, 'SECRET' AS type, CASE c_custkey % 4 WHEN 1 THEN 'AKIA' || translate(upper(left(m, 16)), '01', 'GH') WHEN 3 THEN 'sid=' || m || upper(reverse(m)) || '; Path=/' ELSE m || upper(reverse(m)) END AS value
        FROM (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS m FROM customer) WHERE c_custkey % 4 <> 2""",
    "address_from_keys": """
        SELECT c_custkey, 'ADDRESS' AS type, CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' Old Mill Road, Apt 7' ELSE c_custkey || ' West 5th St NW' END AS value FROM customer WHERE c_custkey % 3 <> 2""",
    "credential_url_forms": "SELECT page_id, page_id % 6 < 4 AS flagged FROM pages",
}
#: The same replacement, one address after the other, longest first, is what rewriting gives when no address holds another.
SQL["mask_documents"] = f"""
    WITH RECURSIVE {MINTED}, todo AS (
      SELECT doc_id, value, k, row_number() OVER (PARTITION BY doc_id ORDER BY length(value) DESC, value) AS i FROM (SELECT DISTINCT doc_id, value FROM hosts) JOIN minted USING (value)
    ), step AS (
      SELECT doc_id, text, CAST(0 AS BIGINT) AS i FROM documents
      UNION ALL
      SELECT step.doc_id, replace(step.text, value, '⟨IPV4_' || k || '⟩'), todo.i FROM step JOIN todo ON step.doc_id = todo.doc_id AND todo.i = step.i + 1
    )
    SELECT doc_id, arg_max(text, i) AS masked FROM step GROUP BY doc_id"""
SQL["mask_conversations"] = """
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, text || ' from ⟨IPV4_1⟩' AS masked FROM conversations"""


SQL["entity_counts_by_type"] = f"""
    WITH {IPS}, cards AS ({SQL["detect_card_documents"]}), mails AS ({SQL["detect_email_ascii_documents"]}), phones AS ({SQL["detect_phone_nanp_documents"]}), secrets AS ({SQL["detect_secret_documents"]}),
    each AS (
      SELECT 'IPV4' AS type, value, 1 AS n FROM hosts UNION ALL SELECT 'CARD', value, n FROM cards UNION ALL SELECT 'EMAIL', value, n FROM mails
      UNION ALL SELECT 'PHONE', value, n FROM phones UNION ALL SELECT 'SECRET', value, n FROM secrets)
    SELECT type, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT value) AS n_values FROM each GROUP BY type"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
