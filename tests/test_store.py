import threading

from pyspark.sql import functions as F

from nymora.operators import mask, restore
from nymora.sources import vault as vaults
from nymora.sources.store import VaultStore

ROWS = "ord long, text string"


def test_two_writers_at_once(spark, tmp_path):
    store, both, out = VaultStore(spark, str(tmp_path / "vault")), threading.Barrier(2), {}
    assert store.read()[1] == 0 and store.read()[0].count() == 0
    batches = {"a": [(i, f"u{i}@a.org and shared@x.org") for i in range(30)], "b": [(i, f"v{i}@b.org and shared@x.org") for i in range(30)]}

    def write(name):
        seen = []

        def mint(vault):
            made = mask.masked_and_new(spark.createDataFrame(batches[name], ROWS), vault)
            if not seen:
                both.wait(60)  # both have read the same version
            seen.append(1)
            return made

        from nymora.sources.store import grow

        out[name] = grow(store, mint)

    threads = [threading.Thread(target=write, args=(n,)) for n in batches]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    vault, version = store.read()
    assert version == 2 and vault.count() == 61 and vaults.faults(vault).count() == 0
    for name, rows in batches.items():
        back = {r.ord: r.restored for r in restore.restore(out[name], vault).collect()}
        assert back == dict(rows)
    assert not store.commit(vault, 0) and not store.commit(vault, 1)


def test_a_batch_that_runs_again_mints_nothing(spark, tmp_path):
    store, source = VaultStore(spark, str(tmp_path / "vault")), str(tmp_path / "in")
    spark.createDataFrame([(1, "bob@x.org"), (2, "ann@x.org")], ROWS).coalesce(1).write.json(source)
    stream = spark.readStream.schema(ROWS).json(source)
    for run in range(2):  # the second without its checkpoint, as if the first had failed after its commit
        query = mask.mask_stream(stream, store, str(tmp_path / "out"), "masking").option("checkpointLocation", str(tmp_path / f"ck{run}")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert store.read()[1] == 1
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.ord: r.masked for r in rows} == {1: "⟨EMAIL_1⟩", 2: "⟨EMAIL_2⟩"} and len(rows) == 2
    assert store.read()[0].agg(F.count_distinct("surrogate")).head()[0] == 2


def test_an_entry_that_is_not_written_yet_is_waited_for(spark, tmp_path, monkeypatch):
    import pytest

    from nymora.sources import store as stores

    store, log = VaultStore(spark, str(tmp_path / "vault")), tmp_path / "vault" / "log"
    one = spark.createDataFrame([("", 0, "EMAIL", "a@x.org", "⟨EMAIL_1⟩", "email")], vaults.SCHEMA)
    assert store.commit(one, 0)
    entry = next(p for p in log.iterdir() if not p.name.startswith("."))
    written = entry.read_bytes()
    for p in log.iterdir():  # as between the entry's creation and its writing; the checksum goes too
        p.unlink()
    entry.touch()
    threading.Timer(1, lambda: entry.write_bytes(written)).start()
    vault, version = store.read()
    assert version == 1 and vault.count() == 1
    entry.write_bytes(b"")
    monkeypatch.setattr(stores, "WAIT_S", 0.2)
    with pytest.raises(vaults.VaultError, match="not written"):
        store.read()
