"""The vault: a table (vault_id, ord, type, original, surrogate, detector), its checks, and its JSON exchange format."""

from __future__ import annotations

import base64
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

SCHEMA = "vault_id string, ord long, type string, original string, surrogate string, detector string"
FIELDS = ("type", "original", "surrogate")


class VaultError(Exception):
    """What is wrong with a vault; never quotes its values."""


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


# --- one vault as JSON, on the driver ---------------------------------------------------------------------------------


def _unique(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise VaultError("a JSON object holds a key twice")
    return out


def _text(value, what: str) -> str:
    if not isinstance(value, str) or not value:
        raise VaultError(f"{what} must be a text that isn't empty")
    try:
        value.encode()
    except UnicodeEncodeError:
        raise VaultError(f"{what} holds half of a surrogate pair") from None
    return value


def parse(data: str) -> list[tuple[str, str, str, str]]:
    """(type, original, surrogate, detector) in order, checked."""
    try:
        vault = json.loads(data, object_pairs_hook=_unique)
    except json.JSONDecodeError as e:
        raise VaultError(f"no JSON: line {e.lineno}, column {e.colno}") from None
    except RecursionError:
        raise VaultError("nested too deeply") from None
    entries = vault.get("mappings") if isinstance(vault, dict) else None
    if not isinstance(entries, list):
        raise VaultError("a vault is an object with a list named mappings")
    version = vault.get("version", 1)
    if type(version) is not int or version != 1:
        raise VaultError("only version 1 is known")
    rows, originals, surrogates = [], set(), set()
    for i, entry in enumerate(entries, 1):
        if not isinstance(entry, dict):
            raise VaultError(f"mapping {i} isn't an object")
        kind, original, surrogate = (_text(entry.get(f), f"mapping {i}: {f}") for f in FIELDS)
        detector = entry.get("detector", "")
        for wrong, what in (
            (kind not in fixed.TYPES, "unknown type"),
            (not isinstance(detector, str), "its detector isn't a text"),
            ((kind, original) in originals, "its original occurs twice"),
            (surrogate in surrogates, "its surrogate occurs twice"),
            (surrogate == original, "its surrogate is its original"),
        ):
            if wrong:
                raise VaultError(f"mapping {i}: {what}")
        originals.add((kind, original))
        surrogates.add(surrogate)
        rows.append((kind, original, surrogate, detector))
    return rows


def from_json(spark: SparkSession, data: str, vault_id: str = "") -> DataFrame:
    return spark.createDataFrame([(vault_id, i, *row) for i, row in enumerate(parse(data))], SCHEMA)


def to_json(vault: DataFrame, vault_id: str = "", indent: int | None = 2) -> str:
    """One vault as text; made for vaults that fit the driver, as the format is a single document."""
    rows = vault.where(F.col("vault_id") == vault_id).orderBy("ord").collect()
    return json.dumps({"version": 1, "mappings": [{**{f: r[f] for f in FIELDS}, "detector": r["detector"]} for r in rows]}, indent=indent, ensure_ascii=False)


def write_text(path: str, text: str) -> None:
    """Replace a local file at once: owner-only, by a temporary neighbour and a rename; symbolic links are refused."""
    if os.path.islink(path):
        raise VaultError("the target is a symbolic link")
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".vault-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def save(vault: DataFrame, path: str, vault_id: str = "") -> None:
    write_text(path, to_json(vault, vault_id))


def load(spark: SparkSession, path: str, vault_id: str = "") -> DataFrame:
    with open(path, encoding="utf-8", newline="") as f:
        return from_json(spark, f.read(), vault_id)


# --- vault tables --------------------------------------------------------------------------------------------------------


def faults(vault: DataFrame) -> DataFrame:
    """(vault_id, fault, n) of what a vault table may not hold; empty for a sound one."""
    bad = F.when(~F.col("type").isin(*fixed.TYPES) | F.col("type").isNull(), "unknown type")
    for name in ("original", "surrogate"):
        bad = bad.when(F.col(name).isNull() | (F.col(name) == ""), f"empty {name}").when(~F.is_valid_utf8(F.col(name)), f"{name} isn't UTF-8")
    bad = bad.when(F.col("surrogate") == F.col("original"), "surrogate is its original")
    single = vault.withColumn("fault", bad).where("fault is not null").groupBy("vault_id", "fault").agg(F.count(F.lit(1)).alias("n"))
    twice = [
        vault.groupBy("vault_id", *keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy("vault_id").agg(F.count(F.lit(1)).alias("n")).select("vault_id", F.lit(f"{keys[-1]} occurs twice").alias("fault"), "n")
        for keys in (("type", "original"), ("surrogate",))
    ]
    return single.unionByName(twice[0]).unionByName(twice[1])


def checked(vault: DataFrame) -> DataFrame:
    """``vault``, or VaultError."""
    found = faults(vault).groupBy("fault").agg(F.sum("n").alias("n")).orderBy("fault").collect()
    if found:
        raise VaultError("; ".join(f"{r['fault']}: {r['n']}" for r in found))
    return vault


def write(vault: DataFrame, path: str) -> None:
    """As Parquet, for one writer at a time; Spark's committer makes the files visible only when all are written."""
    checked(vault).write.mode("overwrite").partitionBy("type").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*(c.split()[0] for c in SCHEMA.split(", ")))


def encrypted(vault: DataFrame, key: bytes) -> DataFrame:
    """Originals as AES-GCM binary (16, 24 or 32 byte key); surrogates stay readable, so tables can be joined without the key."""
    if len(key) not in (16, 24, 32):
        raise VaultError("a key has 16, 24 or 32 bytes")
    return vault.withColumn("original", F.aes_encrypt(F.col("original"), F.lit(key), F.lit("GCM")))


def decrypted(vault: DataFrame, key: bytes) -> DataFrame:
    return vault.withColumn("original", F.aes_decrypt(F.col("original"), F.lit(key), F.lit("GCM")).cast("string"))


def generate_key() -> bytes:
    return os.urandom(32)


# --- Fernet tokens: version 0x80, time, initialisation vector, AES-128 in CBC mode, HMAC-SHA256, all in URL-safe base 64 ----------------


def _keys(key: bytes) -> tuple[bytes, bytes]:
    """(signing, encryption) key of a Fernet key, which is 32 bytes in URL-safe base 64."""
    try:
        raw = base64.urlsafe_b64decode(key)
    except ValueError:
        raw = b""
    if len(raw) != 32:
        raise VaultError("a Fernet key is 32 bytes in URL-safe base 64")
    return raw[:16], raw[16:]


def fernet_key() -> bytes:
    return base64.urlsafe_b64encode(os.urandom(32))


def _hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 by RFC 2104, for keys of up to 64 bytes."""
    inner, outer = (bytes(b ^ mask for b in key.ljust(64, b"\0")) for mask in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256))


def _urlsafe(data: Column) -> Column:
    return F.translate(F.base64(data), "+/\r\n", "-_")


def fernet_encrypted(column: Column, key: bytes, seconds: Column | None = None, vector: Column | None = None) -> Column:
    """A token for each value (string or binary), in the JVM; now and random vectors, unless given."""
    sign, encrypt = _keys(key)
    seconds = F.unix_timestamp() if seconds is None else seconds
    arguments = [column.cast("binary"), F.lit(encrypt), F.lit("CBC"), F.lit("PKCS")]
    sealed = F.aes_encrypt(*arguments, *([] if vector is None else [vector]))  # the vector, then the ciphertext
    message = F.concat(F.lit(b"\x80"), F.unhex(F.lpad(F.hex(seconds.cast("long")), 16, "0")), sealed)
    return _urlsafe(F.concat(message, _hmac(sign, message)))


def fernet_decrypted(token: Column, key: bytes) -> Column:
    """The binary value of each token; null for one that isn't well-formed, or wasn't signed with this key."""
    sign, encrypt = _keys(key)
    data = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64"))
    size = F.octet_length(data)
    message, tag = F.substring(data, F.lit(1), size - 32), F.substring(data, size - 31, F.lit(32))
    sealed = F.substring(data, F.lit(10), size - 41)
    sound = (size >= 73) & (F.substring(data, 1, 1) == F.lit(b"\x80")) & (tag == _hmac(sign, message))
    return F.when(sound, F.try_aes_decrypt(sealed, F.lit(encrypt), F.lit("CBC"), F.lit("PKCS")))


def save_encrypted(vault: DataFrame, path: str, key: bytes, vault_id: str = "") -> None:
    """One vault's JSON as one token in a file."""
    text = vault.sparkSession.createDataFrame([(to_json(vault, vault_id),)], "t string")
    write_text(path, text.select(fernet_encrypted(F.col("t"), key)).head()[0])


def load_encrypted(spark: SparkSession, path: str, key: bytes, vault_id: str = "") -> DataFrame:
    with open(path, encoding="ascii") as f:
        token = spark.createDataFrame([(f.read().strip(),)], "t string")
    plain = token.select(fernet_decrypted(F.col("t"), key)).head()[0]
    if plain is None:
        raise VaultError("no token of this key")
    return from_json(spark, bytes(plain).decode(), vault_id)


def find(vault: DataFrame, surrogate: str | None = None, original: str | None = None) -> DataFrame:
    """The mappings with this surrogate or original."""
    out = vault
    for name, value in (("surrogate", surrogate), ("original", original)):
        out = out if value is None else out.where(F.col(name) == value)
    return out


def longest_first(vault: DataFrame) -> DataFrame:
    return vault.orderBy(F.desc(F.length("surrogate")), "surrogate")
