"""Filters, joins of views, counts, windows and pages that the read surface is made of.

All are declarative, so filters and column choices reach the scan. Orders are total: ties are broken by named keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semforge.functions.text import blank_to_null, is_placeholder, jaccard, ngrams, strip
from semforge.storage import bucketed

#: Characters of a piece of text in the search index.
GRAM = 3

#: Rows of a page at most, as the read surface allows.
PAGE_MOST = 200
STRONG_EVIDENCE = ("strong", "source_preview_and_replay")
BLOCKING = ("CONFLICT", "BLOCK")
INACTIVE = ("DECOMMISSIONED", "INACTIVE", "SCRAPPED", "停用", "报废")


# Filters


def eligible(df: DataFrame) -> DataFrame:
    """Candidates of high confidence with strong evidence that wait, aren't published and have a text."""
    return df.filter((F.col("confidence") == "high") & F.col("evidence_level").isin(*STRONG_EVIDENCE) & (F.col("status") == "candidate") & (F.col("review_state") == "pending") & ~F.coalesce(F.col("published"), F.lit(False)) & blank_to_null(F.col("proposed")).isNotNull())


def search(df: DataFrame, term: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows that have the term in any of the columns, whatever its case; no term filters nothing. Wildcards in it are literal."""
    if not term:
        return df
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.filter(reduce(Column.__or__, [F.col(c).ilike(f"%{escaped}%") for c in columns]))


def search_index(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(gram, keys): the trigrams of the columns' lower-case texts, each once for a row, as a table in buckets of the trigram."""
    grams = F.array_distinct(F.flatten(F.array(*[ngrams(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), GRAM) for c in columns])))
    return bucketed(df.select(F.explode(grams).alias("gram"), *keys), "gram")


def indexed_search(df: DataFrame, index: DataFrame, keys: Sequence[str], term: str | None, columns: Sequence[str]) -> DataFrame:
    """``search`` by an index over the same rows and columns: only the buckets of the term's trigrams are read, and the rows that have all
    of them are held against the term. A term of fewer than three characters has no trigram and scans.

    Keys name a row; rows with equal keys are all found. Common trigrams have long lists of rows, which are counted where they are read.
    """
    low = (term or "").lower()
    grams = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
    if not grams:
        return search(df, term, columns)
    hits = index.filter(F.col("gram").isin(grams)).groupBy(*keys).agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(grams)).drop("_n")
    on = reduce(Column.__and__, [F.col(f"_r.{k}").eqNullSafe(F.col(f"_h.{k}")) for k in keys])
    return search(df.alias("_r").join(hits.alias("_h"), on, "left_semi"), term, columns)


def facet_filter(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """All of the given equalities; null and ``all`` ask for nothing."""
    return reduce(lambda d, kv: d if kv[1] in (None, "", "all") else d.filter(F.col(kv[0]) == kv[1]), values.items(), df)


def has_code(codes: Column, *parts: str) -> Column:
    """Whether any of an array's codes contains any of the parts."""
    return F.coalesce(F.exists(codes, lambda c: reduce(Column.__or__, [c.contains(p) for p in parts])), F.lit(False))


def quick_filter(df: DataFrame, name: str) -> DataFrame:
    """pending, context, low or deferred rows of a review queue."""
    if name == "pending":
        return df.filter(F.col("review_state") == "pending")
    codes = {"context": ("CONTEXT",), "low": ("LOW_",), "deferred": ("DEFER",)}[name]
    return df.filter(has_code(F.col("reason_codes"), *codes))


def auto_approvable(df: DataFrame) -> DataFrame:
    """The proposal equals the original but for blanks at the ends, and no code conflicts or blocks."""
    return df.filter((strip(F.col("proposed")) == strip(F.col("original"))) & ~has_code(F.col("reason_codes"), *BLOCKING))


def assist_eligible(df: DataFrame, audits: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Eligible rows without conflict or block that no earlier audit isolated or deferred."""
    earlier = audits.filter(F.col("decision").isin("isolate", "defer")).select(key).distinct()
    return eligible(df).filter(~has_code(F.col("reason_codes"), *BLOCKING)).join(earlier, key, "left_anti")


def active_only(df: DataFrame, name: str = "name", status: str = "status", inactive: Sequence[str] = INACTIVE) -> DataFrame:
    """Without blank, placeholder and test names and without inactive rows."""
    return df.filter(~is_placeholder(F.col(name)) & ~F.coalesce(F.col(status).isin(*inactive), F.lit(False)))


def published_filter(df: DataFrame, rule: str | None, char_rules: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of one rule: for a character rule those whose original has the characters, else those that list the rule."""
    if not rule or rule == "all":
        return df
    if rule in (char_rules or {}):
        return df.filter(F.col("original").rlike(char_rules[rule]))
    return df.filter(F.array_contains(F.col("rule_ids"), rule))


def as_of(df: DataFrame, time: str, moment: object) -> DataFrame:
    """Rows known by the moment; rows without a time pass."""
    return df.filter(F.col(time).isNull() | (F.col(time) <= F.lit(moment)))


def no_backups(df: DataFrame, table: str) -> DataFrame:
    """Without names of backup tables."""
    return df.filter(~F.lower(F.col(table)).rlike(r"_back$|_?20[0-9]{6}$|626$"))


# Joins


def split_by(df: DataFrame, ids: DataFrame, key: str | Sequence[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with a reason): the two add up to the input, also for rows without a key, which are kept."""
    keys = ids.select(key if isinstance(key, str) else list(key)).distinct()
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi").withColumn("exclusion_reason", F.lit(reason))


def with_parent(df: DataFrame, scope: Sequence[str], code: str, parent: str, label: str) -> DataFrame:
    """Each row with its parent of the same scope: accepted with 1.0 where there is one, else needs_review with 0.0."""
    up = df.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col(code).alias("_code"), F.col(label).alias("parent_label"))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope], F.col(parent) == F.col("_code"))
    out = df.join(up, on, "left")
    found = F.col("_code").isNotNull()
    return out.withColumns({"decision": F.when(found, "accepted").otherwise("needs_review"), "score": F.when(found, 1.0).otherwise(0.0)}).drop("_code", *[f"_{c}" for c in scope])


def prefix_join(events: DataFrame, assets: DataFrame, scope: Sequence[str], location: str) -> DataFrame:
    """Assets of the same scope whose location begins with the event's; rows with blank locations match nothing.

    An asset has as many prefixes as its location has characters, and each is a key: the join is an equality, not a filter of all pairs.
    """
    right = assets.withColumnRenamed(location, "asset_location")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("asset_location"), F.lit(1))), lambda n: F.col("asset_location").substr(F.lit(1), n))
    right = right.withColumn(location, F.explode(prefixes))
    left = events.filter(blank_to_null(F.col(location)).isNotNull())
    return left.join(right, [*scope, location])


def similar_pairs(df: DataFrame, column: str, least: float, n: int = 2) -> DataFrame:
    """(a, b, score) of distinct texts whose sets of n-grams have a Jaccard similarity of ``least`` or more, each pair once.

    Texts this similar share one of their rarest n-grams: of a set of size s, the first s - ceil(least * s) + 1 in the order of rarity.
    Only these are joined, so that a common n-gram pairs nothing; no pair is missed.
    """
    sets = df.select(column).distinct().select(F.col(column).alias("text"), ngrams(F.col(column), n).alias("grams")).filter(F.size("grams") > 0)
    each = sets.select("text", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    rare = each.groupBy("gram").agg(F.count("*").alias("n")).withColumnRenamed("gram", "g")
    order = Window.partitionBy("text").orderBy("n", "gram")
    first = F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1
    kept = each.join(rare, F.col("gram") == F.col("g")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= first).select("text", "size", "gram")
    a, b = kept.select(F.col("text").alias("a"), F.col("size").alias("sa"), "gram"), kept.select(F.col("text").alias("b"), F.col("size").alias("sb"), "gram")
    near = a.join(b, "gram").filter((F.col("a") < F.col("b")) & (F.col("sa") >= F.col("sb") * least) & (F.col("sb") >= F.col("sa") * least)).select("a", "b").distinct()
    both = near.join(sets.select(F.col("text").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("text").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", jaccard(F.col("ga"), F.col("gb")).alias("score")).filter(F.col("score") >= least)


def unmatched(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that refer to no parent."""
    names = {p: f"_{p}" for _, p in on}
    keys = parent.select(*[F.col(p).alias(a) for p, a in names.items()]).distinct()
    return child.join(keys, reduce(Column.__and__, [F.col(c) == F.col(f"_{p}") for c, p in on]), "left_anti")


# Counts


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def facets(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """(value, n) by falling count, then value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(most)


def metadata_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass over the rows: each becomes one row for each column before the count."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def share_of_total(df: DataFrame, key: str, digits: int = 1, most: int | None = None) -> DataFrame:
    """(key, n, share): percent of all rows, rounded half to even. The window runs over the few counted rows."""
    out = df.groupBy(key).agg(F.count("*").alias("n"))
    out = out.withColumn("share", F.bround(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), digits))
    return out if most is None else out.orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(most)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return counts_by(df, *keys).filter("n > 1")


def conflicts(df: DataFrame, keys: Sequence[str], value: str, most: int = 20) -> DataFrame:
    """Keys with more than one value: how many, and the first of them in order."""
    distinct = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    ranked = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= most, F.col(value)))).alias("values")).filter("n_values > 1")


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, variants): each key's commonest value, the smallest of equals, and how many values it has."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), F.col(value).alias("v")))
    return counted.groupBy(key).agg(best.alias("best"), F.count("*").alias("variants")).select(key, F.col("best.v").alias(value), (-F.col("best.c")).alias("n"), "variants")


def context_clusters(df: DataFrame, keys: Sequence[str], text: str, examples: int = 5) -> DataFrame:
    """Clusters of two members or more, with counts and the first distinct texts."""
    distinct = df.groupBy(*keys, text).agg(F.count("*").alias("c"))
    ranked = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(text)))
    return ranked.groupBy(*keys).agg(F.sum("c").alias("members"), F.count("*").alias("distinct_texts"), F.concat_ws(" | ", F.array_sort(F.collect_list(F.when(F.col("_rank") <= examples, F.col(text))))).alias("examples")).filter("members >= 2")


def exploded_counts(df: DataFrame, array: str, name: str = "value") -> DataFrame:
    """How many rows list each element; an element listed twice in a row counts once."""
    return df.select(F.explode(F.array_distinct(array)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def with_examples(df: DataFrame, key: str, order: Sequence[str], example: str, most: int = 3) -> DataFrame:
    """(key, n, examples): counts and the first few examples of each key."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= most, F.struct("_rank", F.col(example).cast("string").alias("x"))))), lambda s: s["x"])).alias("examples"))


# Windows, order and pages


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def lag_chain(df: DataFrame, keys: Sequence[str], time: str, id_: str) -> DataFrame:
    """Adds previous_id, the row before within the keys; rows without a time come last."""
    order = [F.col(time).asc_nulls_last(), F.col(id_)]
    return df.withColumn("previous_id", F.lag(id_).over(Window.partitionBy(*keys).orderBy(*order)))


def trend(df: DataFrame, keys: Sequence[str], time: str, value: str, id_: str) -> DataFrame:
    """(keys, n, first_value, last_value, delta, direction) of two timed points or more."""
    point = F.struct(F.col(time).alias("t"), F.col(id_).alias("i"), F.col(value).alias("v"))
    out = df.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(point)["v"].alias("first_value"), F.max(point)["v"].alias("last_value")).filter("n >= 2")
    out = out.withColumn("delta", F.col("last_value") - F.col("first_value"))
    return out.withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat"))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page, from 1, in a total order. Spark takes the first number x size rows without sorting the rest."""
    if number < 1 or size < 1:
        raise ValueError("pages and sizes start at 1")
    size = min(size, PAGE_MOST)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def status_order(column: str, statuses: Sequence[str]) -> Column:
    """Sort key that puts the named statuses first, in their order, and all others after."""
    return reduce(lambda c, kv: c.when(F.col(column) == kv[1], kv[0]), enumerate(statuses), F.when(F.lit(False), -1)).otherwise(len(statuses))


def detail(parents: DataFrame, key: str, value: object, children: Mapping[str, tuple[DataFrame, Sequence[str], int]]) -> DataFrame:
    """One parent row with ordered, bounded lists of its children; a missing child list is empty.

    ``children``: name to (rows with the same key, columns whose order counts, most rows).
    """
    out = parents.filter(F.col(key) == value)
    for name, (rows, order, most) in children.items():
        own = rows.filter(F.col(key) == value).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rank") <= most)
        lists = own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", *[c for c in rows.columns if c != key]))), lambda s: s.dropFields("_rank")).alias(name))
        out = out.join(lists, key, "left")
    return out


# Merges


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], ignore: bool = False) -> DataFrame:
    """Upsert: new rows replace old ones of equal keys, or with ``ignore`` are left out. Null keys equal null keys."""
    names = old.columns
    first, second = (old, new.select(names)) if ignore else (new.select(names), old)
    other = second.alias("b").join(first.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct(), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
    return first.unionByName(other)
