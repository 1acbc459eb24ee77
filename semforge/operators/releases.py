"""Releases of a published dataset: prepared, approved, backed up, activated and rolled back.

Rows and ledger lie in one folder that driver and executors share. A release's rows are a folder that is named by their content and its
contract and never changes; the ledger is a Parquet table to which each event adds one row. What is active follows from the ledger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semforge.functions.ids import content_hash
from semforge.sources.snapshots import digest_of

LEDGER = "seq long, event string, release string, other string, digest string, actor string"


class ReleaseError(ValueError):
    """A release that isn't known, isn't approved, or whose rows are not those that were prepared."""


class Releases:
    """One process writes at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    @property
    def ledger(self) -> DataFrame:
        """One row for each event, in the order of ``seq``."""
        at = f"{self.folder}/ledger"
        return self.spark.read.schema(LEDGER).parquet(at) if self._exists(at) else self.spark.createDataFrame([], LEDGER)

    def _add(self, event: str, release: str, other: str | None = None, digest: str | None = None, actor: str | None = None) -> None:
        seq = (self.ledger.agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(seq, event, release, other, digest, actor)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def _last(self, *events: str, release: str | None = None):
        rows = self.ledger.filter(F.col("event").isin(*events))
        return (rows if release is None else rows.filter(F.col("release") == release)).orderBy(F.desc("seq")).first()

    @property
    def active(self) -> str | None:
        row = self._last("activated", "rolled_back")
        return row["release"] if row else None

    def rows(self, release: str | None = None) -> DataFrame:
        """The rows of a release, the active one unless it is named."""
        release = release or self.active
        if release is None or self._last("prepared", release=release) is None:
            raise ReleaseError(f"there is no release {release}")
        return self.spark.read.parquet(f"{self.folder}/{release}")

    def prepare(self, df: DataFrame, contract: Mapping) -> str:
        """Writes the rows and returns the release's id. The same rows under the same contract are one release."""
        digest = digest_of(df).first()["digest"]
        release = f"REL-{content_hash([dict(contract), digest])[:16]}"
        if self._last("prepared", release=release) is None:
            df.write.mode("overwrite").parquet(f"{self.folder}/{release}")
            self._add("prepared", release, None, digest)
        return release

    def approve(self, release: str, actor: str) -> None:
        if self._last("prepared", release=release) is None:
            raise ReleaseError(f"there is no release {release}")
        if self._last("approved", release=release) is None:
            self._add("approved", release, actor=actor)

    def activate(self, release: str) -> None:
        """Only an approved release whose rows are those that were prepared; what was active is noted as its backup before."""
        if self._last("approved", release=release) is None:
            raise ReleaseError(f"{release} isn't approved")
        self._verified(release)
        before = self.active
        if before != release:
            if before is not None:
                self._add("backed_up", before, release, digest_of(self.rows(before)).first()["digest"])
            self._add("activated", release, before)

    def _verified(self, release: str) -> None:
        if digest_of(self.rows(release)).first()["digest"] != self._last("prepared", release=release)["digest"]:
            raise ReleaseError(f"the rows of {release} have changed since it was prepared")

    def rollback(self) -> str:
        """Activates again what the active release had replaced, once its rows are verified; each rollback goes one activation back."""
        row = self._last("activated", "rolled_back")
        if row is None or row["other"] is None:
            raise ReleaseError("there is no earlier release")
        self._verified(row["other"])
        before = self._last("activated", release=row["other"])
        self._add("rolled_back", row["other"], before["other"])
        return row["other"]
