"""A vault with several writers: a log of versions, each a table of new mappings, committed by whoever creates its log entry first.

A writer reads a version, masks with it, writes its new mappings to a folder of its own and creates the next version's log entry, which fails if another
writer was faster; then it reads again and mints anew. Readers see committed folders only. The file system's ``create`` must be exclusive, as on
HDFS and local disks; a store without that needs one writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import vault as vaults


#: Seconds in which a writer must have written the log entry that it created.
WAIT_S = 30


class Conflict(vaults.VaultError):
    """Other writers were faster, every time."""


class VaultStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("log").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def log(self) -> list[tuple[str, str]]:
        """(folder, tag) of each version, in order."""
        if not self._fs.exists(self._at("log")):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("log")) if not s.getPath().getName().startswith((".", "_")))
        return [self._entry(name) for name in names]

    def _entry(self, name: str) -> tuple[str, str]:
        """(folder, tag) of a log entry. One that was created but isn't written yet is waited for: without it a reader would miss mappings."""
        last = time.monotonic() + WAIT_S
        while True:
            stream = self._fs.open(self._at(f"log/{name}"))
            try:
                folder, end, tag = bytes(stream.readAllBytes()).decode().partition("\n")
            finally:
                stream.close()
            if end:
                return folder, tag
            if time.monotonic() > last:
                raise vaults.VaultError(f"log entry {name} was created but not written; remove it if its writer is gone")
            time.sleep(0.05)

    def read(self) -> tuple[DataFrame, int]:
        """(the vault, its version)."""
        log = self.log()
        folders = [f"{self.path}/data/{folder}" for folder, _ in log if folder]
        return (self.spark.read.schema(vaults.SCHEMA).parquet(*folders) if folders else vaults.empty(self.spark)), len(log)

    def commit(self, new: DataFrame, version: int, tag: str = "") -> bool:
        """Makes ``new`` mappings version ``version`` + 1; False if that version is there already."""
        folder = uuid.uuid4().hex
        new.write.parquet(f"{self.path}/data/{folder}")
        entry = self._at(f"log/{version + 1:020d}")
        if self._fs.exists(entry):  # spares an exception; the exclusive create decides
            return False
        try:
            stream = self._fs.create(entry, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(f"{folder}\n{tag}".encode())
        finally:
            stream.close()
        return True


def grow(store: VaultStore, mint: Callable[[DataFrame], tuple[DataFrame, DataFrame]], tag: str = "", tries: int = 20) -> DataFrame:
    """The masked rows of ``mint(vault)``, which gives (masked, new mappings), once its new mappings are committed.

    With a ``tag`` that the log has already, as after a restart, the mappings are there: nothing is committed again.
    """
    for _ in range(tries):
        vault, version = store.read()
        masked, new = mint(vault)
        if tag and any(t == tag for _, t in store.log()[:version]) or not new.limit(1).count() or store.commit(new, version, tag):
            return masked
    raise Conflict(f"no version could be committed in {tries} tries")
