"""A physical layout for quads that are queried often: a table bucketed and sorted by subject, with the number of statements by predicate.

Patterns about one subject meet where they lie: rows of a subject are in one bucket, so that joins and distincts by subject need no
exchange. The counts order the patterns of a query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.storage import bucketed

#: Predicates whose counts are held: those of a vocabulary. Rarer ones count as the rarest of these.
MOST_PREDICATES = 10_000


@dataclass(frozen=True)
class Store:
    """``quads`` as stored; ``counts``: statements by predicate; ``rest``: at least as many as any predicate that is not in ``counts``."""

    quads: DataFrame
    counts: dict[str, int]
    rest: int = 0

    def rows(self, predicate: str | None) -> int:
        return sum(self.counts.values()) if predicate is None else self.counts.get(predicate, self.rest)


def store(quads: DataFrame, buckets: int | None = None) -> Store:
    """Writes the quads once, in the shared folder, until the driver ends."""
    stored = bucketed(quads, "subject", buckets)
    found = stored.groupBy("predicate").count().orderBy(F.desc("count"), "predicate").limit(MOST_PREDICATES).collect()
    counts = {r["predicate"]: r["count"] for r in found}
    return Store(stored, counts, min(counts.values(), default=0) if len(counts) == MOST_PREDICATES else 0)
