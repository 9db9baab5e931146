"""Queries and their SQL on small tables with what generated ones hold seldom."""

import pytest
from compare import TABLES, spark_rows, sql_rows

from nymora.plans import queries as plans

TEXTS = [
    "zu ver 42.244.84.203 und 8.8.4.4", "driver 1.2.3.4, v 1.2.3.5", "Chrome/1.2.3.6 ~\n1.2.3.7 ok 1.2.3.8.", "version            9.9.9.9", "1.2.3.4 2.3.4.5,ver 3.4.5.6",
    "order +1 (234) 567-8901 and +1 (234) 567-8902", "call #+1 (234) 567-8903 or +1 (234) 567-8904x12", "x+1 (234) 567-8905 +1 (234) 567-8906b",
    "12 234 567 8901 234 567 8902 and 234-567-8903, 1234.567.8904 234 567 8905x", "order 234 567 8906 #(234) 567-8907 (234)567 8908 +234 567 8909 a(234) 567-8910",
]
COLONS = ["at a:1.2.3.4:5 :9.9.9.9 x", "fe80::1%e-1.2.3.4 and ::5.6.7.8"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, tables):
    out = tmp_path_factory.mktemp("odd")
    made = {
        "documents": ([(i, t, "de", "web", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long"),
        "customer": ([(k,) for k in (1, 2, 3, 65533, 65534, 65535, 65537, 65538, 70003, 1048577)], "c_custkey long"),
        "conversations": ([(1, 0, "user", "zu ver"), (1, 1, "assistant", "ok"), (2, 0, "user", "ok"), (2, 1, "assistant", "das Release"), (3, 0, "user", "build")], "conv_id long, turn long, role string, text string"),
    }
    for t in TABLES:
        df = spark.createDataFrame(*made[t]) if t in made else spark.read.parquet(f"{tables}/{t}.parquet")
        df.coalesce(1).write.parquet(str(out / f"{t}.parquet"))
    return str(out)


@pytest.mark.parametrize("name", ["audit_new_pii", "detect_ipv4_documents", "detect_phone_nanp_documents", "entity_counts_by_lang", "ipv6_from_keys", "mask_chat_messages", "mask_documents", "restore_exact_roundtrip", "vault_mint"])
def test_query(spark, odd, name):
    assert spark_rows(plans.queries()[name](spark, odd)) == sql_rows(odd, plans.oracle_sql()[name])


def test_addresses_in_what_looks_like_ipv6(tmp_path):
    import duckdb

    from nymora.functions.scan import find_ip

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate([*TEXTS, *COLONS])))
    want = sorted((i, t[h.start : h.end]) for i, t in enumerate([*TEXTS, *COLONS]) for h in find_ip(t) if h.type == "IPV4")
    assert sorted(con.execute(f"WITH {plans.IPS} SELECT doc_id, value FROM hosts").fetchall()) == want
