"""Stable identifiers, hashes and IRIs as Columns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *cols: Column, n: int = 24) -> Column:
    """``prefix-`` and n hex digits of the SHA-256 of all parts joined by a bar. A null part counts as an empty one."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n))


def row_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of the row as JSON with sorted keys. Null fields are left out, so a missing and a null field hash alike."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), 256)


def content_hash(value: object, ignore: Iterable[str] = ("run_id", "created_at", "generated_at", "updated_at")) -> str:
    """SHA-256 of a manifest-sized value as canonical JSON, at any depth without the keys that change from run to run."""
    drop = set(ignore)

    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in drop}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return hashlib.sha256(json.dumps(clean(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def iri_segment(col: Column) -> Column:
    """Percent-encodes all but letters, digits and ``-._~``; null and empty become ``unknown``."""
    text = F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit("unknown"))
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def source_iri(base: str, namespace: Column, kind: str, key: Column) -> Column:
    return F.concat(F.lit(base), iri_segment(namespace), F.lit(f"/{kind}/"), iri_segment(key))


def local_name(iri: Column) -> Column:
    """What follows the last hash or slash."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def snake_case(name: Column) -> Column:
    """PascalCase to snake_case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def path_key(iri: Column) -> Column:
    """The last path segment of an IRI, decoded."""
    return F.url_decode(F.replace(F.element_at(F.split(iri, "/"), -1), F.lit("+"), F.lit("%2B")))


def derived_snapshot(ids: Column) -> Column:
    """An array of snapshot ids to one: none to null, one as it is, more to ``derived:`` and a hash of the sorted set."""
    some = F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != ""))))
    many = F.concat(F.lit("derived:"), F.substring(F.sha2(F.concat_ws("|", some), 256), 1, 24))
    return F.when(F.size(some) == 0, F.lit(None).cast("string")).when(F.size(some) == 1, F.element_at(some, 1)).otherwise(many)
