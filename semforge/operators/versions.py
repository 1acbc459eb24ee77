"""Versions of an ontology in a ledger that is only ever added to: registered, snapshotted, migrated, activated, rolled back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semforge.functions.ids import content_hash
from semforge.sources.snapshots import digest_of

LEDGER = "seq long, event string, version string, other string, hashes map<string,string>, detail string"


class VersionError(ValueError):
    """A version that isn't known, isn't active, or didn't pass its checks."""


class Versions:
    """The ledger is a Parquet table in the given folder, which driver and executors share; each event adds one row, none is changed.

    One process writes at a time. What is active is the version of the last activation or rollback.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def ledger(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(T.StructType.fromDDL(LEDGER)).parquet(f"{self.folder}/ledger")

    def _add(self, event: str, version: str, other: str | None = None, hashes: Mapping[str, str] | None = None, detail: str | None = None) -> None:
        seq = (self.ledger.agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(seq, event, version, other, dict(hashes or {}), detail)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def state(self) -> DataFrame:
        """(version, status, parent, hashes) of each version, by its last registration."""
        last = self.ledger.filter("event = 'registered'").groupBy("version").agg(F.max_by(F.struct("other", "hashes"), "seq").alias("r"))
        active = self.active
        return last.select("version", F.when(F.col("version").eqNullSafe(F.lit(active)), "active").otherwise("available").alias("status"), F.col("r.other").alias("parent"), F.col("r.hashes").alias("hashes"))

    @property
    def active(self) -> str | None:
        r = self.ledger.filter("event IN ('activated', 'rolled_back')").orderBy(F.desc("seq")).select("version").first()
        return r["version"] if r else None

    def _known(self, version: str) -> None:
        if not self.ledger.filter((F.col("event") == "registered") & (F.col("version") == version)).limit(1).count():
            raise VersionError(f"version {version} isn't registered")

    def register(self, version: str, assets: Mapping[str, DataFrame], parent: str | None = None) -> None:
        """A version with the digest of each of its assets. Registering the same again adds nothing."""
        hashes = {name: digest_of(df).first()["digest"] for name, df in sorted(assets.items())}
        known = self.state().filter(F.col("version") == version).first()
        if known is None or dict(known["hashes"]) != hashes or known["parent"] != parent:
            self._add("registered", version, parent, hashes)

    def activate(self, version: str, failures: DataFrame) -> None:
        """Only with an empty table of failures, as the standards gate gives it."""
        self._known(version)
        if (first := failures.first()) is not None:
            raise VersionError(f"{version} didn't pass: {first[0]}")
        if self.active != version:
            self._add("activated", version, self.active)

    def snapshot(self, df: DataFrame, version: str | None = None) -> str:
        """Writes the dataset of a version, the active one unless it is named; its folder is named by its content and never changes."""
        version = version or self.active
        if version is None:
            raise VersionError("there is no active version")
        self._known(version)
        digest = digest_of(df).first()["digest"]
        path = f"{self.folder}/snapshots/{content_hash([version, digest])[:24]}"
        if not self.ledger.filter((F.col("event") == "snapshotted") & (F.col("detail") == path)).limit(1).count():
            df.write.mode("overwrite").parquet(path)
            self._add("snapshotted", version, None, {"dataset": digest}, path)
        return path

    def prepare_migration(self, old: str, new: str) -> str:
        """The id of a migration from the active version; prepared once."""
        self._known(new)
        if self.active != old:
            raise VersionError(f"{old} isn't active")
        name = f"migration-{old}-to-{new}"
        if not self.ledger.filter((F.col("event") == "migration_prepared") & (F.col("detail") == name)).limit(1).count():
            self._add("migration_prepared", new, old, None, name)
        return name

    def migrate(self, old: str, new: str, failures: DataFrame) -> None:
        """Activates a version whose migration is prepared."""
        name = f"migration-{old}-to-{new}"
        if self.active != old or not self.ledger.filter((F.col("event") == "migration_prepared") & (F.col("detail") == name)).limit(1).count():
            raise VersionError(f"{name} isn't prepared")
        self.activate(new, failures)

    def rollback(self, version: str) -> str | None:
        """Points back to a known version; returns the one that was active."""
        self._known(version)
        before = self.active
        if before != version:
            self._add("rolled_back", version, before)
        return before


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) between two snapshots: added, removed or changed; rows that agree in all columns are absent. Null keys compare equal."""
    rest = [c for c in new.columns if c not in keys]
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in rest])) if rest else F.lit(""), 256)
    a, b = (df.select(*[F.col(k).alias(f"_{side}{k}") for k in keys], h.alias(f"_{side}h")).distinct() for df, side in ((old, "a"), (new, "b")))
    on = [F.col(f"_a{k}").eqNullSafe(F.col(f"_b{k}")) for k in keys]
    change = F.when(F.col("_ah").isNull(), "added").when(F.col("_bh").isNull(), "removed").when(F.col("_ah") != F.col("_bh"), "changed")
    return a.join(b, on, "full_outer").select(*[F.coalesce(F.col(f"_a{k}"), F.col(f"_b{k}")).alias(k) for k in keys], change.alias("change")).filter("change IS NOT NULL")
