"""The engine's front: one object with a session, detectors, names, a surrogate generator and a vault."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession

from .functions import fixed
from .functions.surrogates import Placeholders
from .operators import audit, detect, documents, mask, restore
from .sources import vault as vaults
from .streaming import restore as streams


class Engine:
    """Masks and restores DataFrames with a vault that grows by every batch that was verified."""

    def __init__(self, spark: SparkSession, detectors: Iterable[str] = fixed.DEFAULT_DETECTORS, names: Iterable = (), generator=None, vault: DataFrame | None = None):
        self.spark, self.detectors, self.names = spark, detect.checked(detectors), list(names)
        self.generator = generator or Placeholders()
        self.vault = vault if vault is not None else vaults.empty(spark)

    def entities(self, text: Column | str, field: Column | str | None = None, resolved: bool = True) -> Column:
        return detect.entities(text, field, self.detectors, self.names, resolved)

    def find(self, df: DataFrame, text: str = "text", field: str | None = None) -> DataFrame:
        return df.withColumn("entities", self.entities(text, field))

    def mask(self, df: DataFrame, text: str = "text", ord: str = "ord", vault_id: str | None = None, field: str | None = None) -> DataFrame:
        """``df`` with masked and entities; the vault changes only if the whole batch restores to its sources."""
        out, self.vault = mask.mask(df, self.vault, text, ord, vault_id, field, self.detectors, self.names, self.generator)
        return out

    def restore(self, df: DataFrame, text: str = "masked", vault_id: str | None = None, tolerant: bool = True, mode: str = "text") -> DataFrame:
        return restore.restore(df, self.vault, text, vault_id, tolerant, mode)

    def audit(self, df: DataFrame, text: str = "text", vault_id: str | None = None, detectors: Iterable[str] | None = None) -> DataFrame:
        return audit.findings(df, self.vault, text, vault_id, self.detectors if detectors is None else detectors)

    def mask_documents(self, df: DataFrame, text: str = "text", ord: str = "ord", vault_id: str | None = None, style: str = "values") -> DataFrame:
        out, self.vault = documents.mask_documents(df, self.vault, text, ord, vault_id, style, self.detectors, names=self.names, generator=self.generator)
        return out

    def restore_documents(self, df: DataFrame, text: str = "masked", vault_id: str | None = None, style: str = "values", tolerant: bool = True) -> DataFrame:
        return documents.restore_documents(df, self.vault, text, vault_id, style, tolerant)

    def restore_stream(self, chunks: DataFrame, mode: str = "text", vault_id: str = "", **times) -> DataFrame:
        """For streaming and batch DataFrames of chunks; ``times`` (idle, finished) bound the state of streaming ones."""
        if chunks.isStreaming:
            return streams.restore_stream(chunks, self.vault, mode, vault_id, **times)
        return streams.restore_chunks(chunks, self.vault, mode, vault_id)
