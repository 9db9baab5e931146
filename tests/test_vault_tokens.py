import base64
import os

import pytest
from pyspark.sql import functions as F

from nymora.sources import vault as vaults

#: The published example of the format.
KEY, TOKEN = b"cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4=", "gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="


def test_published_token(spark):
    one = spark.createDataFrame([("hello",)], "t string")
    made = one.select(vaults.fernet_encrypted(F.col("t"), KEY, F.lit(499162800), F.lit(bytes(range(16))))).head()[0]
    assert made == TOKEN
    assert bytes(spark.createDataFrame([(TOKEN,)], "t string").select(vaults.fernet_decrypted(F.col("t"), KEY)).head()[0]) == b"hello"


def test_what_is_not_a_token_of_this_key(spark):
    raw = base64.urlsafe_b64decode(TOKEN)
    flipped = [base64.urlsafe_b64encode(raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1 :]).decode() for i in range(len(raw))]
    rows = spark.createDataFrame([(t,) for t in [*flipped, "", "!!", TOKEN[:-8], base64.urlsafe_b64encode(b"\x80" * 60).decode()]] + [(None,)], "t string")
    assert rows.where(vaults.fernet_decrypted(F.col("t"), KEY).isNotNull()).count() == 0
    assert spark.createDataFrame([(TOKEN,)], "t string").where(vaults.fernet_decrypted(F.col("t"), vaults.fernet_key()).isNotNull()).count() == 0
    for key in (b"", b"short", KEY[:-4]):
        with pytest.raises(vaults.VaultError):
            vaults.fernet_encrypted(F.lit("x"), key)


def test_values_and_files_come_back(spark, tmp_path):
    values = ["", "é" * 15, "x" * 16, "🔑" * 1000, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").withColumn("k", vaults.fernet_encrypted(F.col("t"), KEY))
    rows = df.select("i", "k", vaults.fernet_decrypted(F.col("k"), KEY).cast("string").alias("back")).collect()
    assert {r.i: r.back for r in rows} == dict(enumerate(values)) and len({r.k for r in rows}) == 5
    vault = spark.createDataFrame([("", 0, "EMAIL", "bob@x.org", "⟨EMAIL_1⟩", "email")], vaults.SCHEMA)
    path, key = str(tmp_path / "vault"), vaults.fernet_key()
    vaults.save_encrypted(vault, path, key)
    assert os.stat(path).st_mode & 0o077 == 0 and b"bob" not in open(path, "rb").read()
    assert vaults.load_encrypted(spark, path, key).collect() == vault.collect()
    with pytest.raises(vaults.VaultError):
        vaults.load_encrypted(spark, path, vaults.fernet_key())
