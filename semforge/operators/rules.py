"""Cleaning rules: a small vocabulary compiled to Columns, its scope, replay against cases, and mining of candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semforge.functions.ids import stable_id
from semforge.functions.text import BLANK, ENDS, _nfkc, collapse, format_text, nfkc, strip

#: Name of the Python function that rules with NFKC call in SQL.
_NFKC = "rule_nfkc"

OPERATIONS = ("replace", "trim", "normalize", "keep_original", "block")
MODES = ("legacy", "nfkc", "whitespace", "nfkc_whitespace")
CONDITIONS = ("contains", "prefix", "suffix", "descriptionContains")
SCOPES = ("sites", "classes", "parents", "codes", "prefixes")


class RuleError(ValueError):
    """A rule outside the vocabulary; it is refused when it is made, not when rows come."""


@dataclass(frozen=True)
class Rule:
    """One rule: guards that must all hold, then one operation. An empty scope is any row."""

    rule_id: str
    operation: str
    condition: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)
    scope: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise RuleError(f"operation {self.operation} isn't allowed")
        if unknown := [k for k in self.condition if k not in (*CONDITIONS, "descriptionPattern")] + [k for k in self.scope if k not in SCOPES]:
            raise RuleError(f"unknown keys {unknown}")
        if self.operation == "replace":
            source, target = self.parameters.get("from", ""), self.parameters.get("to", "")
            if not source or source == target:
                raise RuleError("replace needs a source other than its target")
            if max(len(source), len(target)) > 80:
                raise RuleError("texts of a replacement have 80 characters at most")
        if self.operation == "normalize" and self.parameters.get("mode", "legacy") not in MODES:
            raise RuleError("unknown mode")


def transform(col: Column, rule: Rule) -> Column:
    """struct(matched, text, reason) of the rule on a text; null is an empty text."""
    text = F.coalesce(col, F.lit(""))
    c, p = rule.condition, rule.parameters
    contains = c.get("contains", c.get("descriptionContains"))
    misses: list[tuple[Column, str]] = []
    if "descriptionPattern" in c and contains is None and "prefix" not in c and "suffix" not in c:
        misses.append((F.lit(True), "unsupported_description_pattern"))
    if contains is not None:
        misses.append((~text.contains(F.lit(contains)), "condition_not_matched"))
    if "prefix" in c:
        misses.append((~text.startswith(F.lit(c["prefix"])), "prefix_not_matched"))
    if "suffix" in c:
        misses.append((~text.endswith(F.lit(c["suffix"])), "suffix_not_matched"))
    if rule.operation == "replace":
        misses.append((~text.contains(F.lit(p["from"])), "source_not_matched"))
        new, matched = F.replace(text, F.lit(p["from"]), F.lit(p.get("to", ""))), F.lit(True)
    elif rule.operation == "trim":
        new = strip(text)
        matched = new != text
    elif rule.operation == "normalize":
        mode = p.get("mode", "legacy")
        new = collapse(text) if mode == "whitespace" else nfkc(text) if mode == "nfkc" or not p.get("whitespace", True) else collapse(nfkc(text))
        matched = new != text
    else:
        new, matched = text, F.lit(True)

    def out(ok: Column, value: Column, reason: str) -> Column:
        return F.struct(ok.alias("matched"), value.alias("text"), F.lit(reason).alias("reason"))

    return reduce(lambda acc, m: F.when(m[0], out(F.lit(False), text, m[1])).otherwise(acc), reversed(misses), out(matched, new, rule.operation))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _change_sql(rule: Rule) -> str:
    """A SQL condition on ``text``: the rule matches and its result differs."""
    t = "coalesce(text, '')"
    c, p = rule.condition, rule.parameters
    contains = c.get("contains", c.get("descriptionContains"))
    if "descriptionPattern" in c and contains is None and "prefix" not in c and "suffix" not in c:
        return "false"
    tests = [f"{name}({t}, {_quoted(c[key])})" for name, key in (("startswith", "prefix"), ("endswith", "suffix")) if key in c]
    if contains is not None:
        tests.append(f"contains({t}, {_quoted(contains)})")
    if rule.operation == "replace":
        tests.append(f"contains({t}, {_quoted(p['from'])})")
    elif rule.operation == "trim":
        tests.append(f"regexp_replace({t}, {_quoted(ENDS)}, '') <> {t}")
    elif rule.operation == "normalize":
        mode = p.get("mode", "legacy")
        plain = t if mode == "whitespace" else f"{_NFKC}({t})"
        whole = mode == "nfkc" or (mode != "whitespace" and not p.get("whitespace", True))
        tests.append(f"{plain} <> {t}" if whole else f"trim(regexp_replace({plain}, {_quoted(BLANK)}, ' ')) <> {t}")
    else:
        return "false"
    return " AND ".join(tests)


def register_sql(spark, rules: Sequence[Rule], name: str = "rule_local_match") -> str:
    """A SQL function name(text, pattern_key) that is 1 where the rule of that id would change the text, else 0; null is an empty text.

    Rules become one SQL expression, which Spark puts in the place of each call. Only NFKC has no expression in SQL: where some rule asks
    for it, its condition calls a Python function on Arrow batches.
    """
    cases = {r.rule_id: _change_sql(r) for r in rules}
    if any(_NFKC in x for x in cases.values()):
        spark.udf.register(_NFKC, _nfkc)
    whens = "".join(f" WHEN {_quoted(k)} THEN CAST({x} AS INT)" for k, x in cases.items())
    body = f"CASE pattern_key{whens} ELSE 0 END" if whens else "0"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, pattern_key STRING) RETURNS INT RETURN {body}")
    return name


def in_scope(rule: Rule, columns: dict[str, str] | None = None) -> Column:
    """All of the scope's lists hold; columns tells which column each list is about."""
    at = {"sites": "site", "classes": "class", "parents": "parent", "codes": "location", "prefixes": "location"} | (columns or {})
    tests = [F.col(at[k]).isin(*v) if k != "prefixes" else reduce(Column.__or__, [F.col(at[k]).startswith(x) for x in v]) for k, v in rule.scope.items() if v]
    return reduce(Column.__and__, tests, F.lit(True))


def apply_rule(df: DataFrame, column: str, rule: Rule, columns: dict[str, str] | None = None) -> DataFrame:
    """Adds result, the struct of the rule; rows out of scope don't match."""
    miss = F.struct(F.lit(False).alias("matched"), F.coalesce(F.col(column), F.lit("")).alias("text"), F.lit("out_of_scope").alias("reason"))
    return df.withColumn("result", F.when(in_scope(rule, columns), transform(F.col(column), rule)).otherwise(miss))


def impact(df: DataFrame, column: str, rule: Rule) -> DataFrame:
    """(rule_id, targets, matched, changed) over the rows of the rule's scope."""
    r = apply_rule(df, column, rule)
    inside = F.col("result.reason") != "out_of_scope"
    return r.agg(F.lit(rule.rule_id).alias("rule_id"), F.count_if(inside).alias("targets"), F.count_if(F.col("result.matched")).alias("matched"), F.count_if(F.col("result.matched") & (F.col("result.text") != F.coalesce(F.col(column), F.lit("")))).alias("changed"))


def replay_rule(cases: DataFrame, rule: Rule) -> DataFrame:
    """Cases (case_id, input, expected) to (case_id, outcome, message): a case that the rule doesn't match passes."""
    r = apply_rule(cases, "input", rule)
    ok = ~F.col("result.matched") | (F.col("result.text") == F.col("expected"))
    return r.select("case_id", F.when(ok, "pass").otherwise("fail").alias("outcome"), F.when(~F.col("result.matched"), F.col("result.reason")).when(ok, "equal").otherwise("differs").alias("message"))


def mine_rules(rows: DataFrame, column: str, catalog: Sequence[Rule], cases: DataFrame | None = None, examples: int = 5) -> DataFrame:
    """(rule_id, n, examples) of catalogue rules that would change rows; a rule that fails any case is left out.

    All rules are tried in one pass: each row explodes into the rules that change it.
    """
    hits = F.array_compact(F.array(*[F.when(transform(F.col(column), r)["matched"] & (transform(F.col(column), r)["text"] != F.col(column)), F.lit(r.rule_id)) for r in catalog]))
    hit = rows.select(F.col(column).alias("text"), F.explode(hits).alias("rule_id"))
    distinct = hit.groupBy("rule_id", "text").agg(F.count("*").alias("c"))
    out = distinct.groupBy("rule_id").agg(F.sum("c").alias("n"), F.slice(F.array_sort(F.collect_set("text")), 1, examples).alias("examples")) if examples < 1 else distinct.withColumn("_r", F.row_number().over(_by_rule())).groupBy("rule_id").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.col("text")))).alias("examples"))
    if cases is not None:
        failed = reduce(DataFrame.union, [replay_rule(cases, r).filter("outcome = 'fail'").select(F.lit(r.rule_id).alias("rule_id")) for r in catalog])
        out = out.join(failed.distinct(), "rule_id", "left_anti")
    return out


def _by_rule():
    from pyspark.sql import Window

    return Window.partitionBy("rule_id").orderBy("text")


def replay_cleaning(approved: DataFrame, source: DataFrame, recompute: Column) -> DataFrame:
    """Approved rows (row_id, original, proposed, identity) against the source (row_id, current, current_identity): five named checks."""
    joined = approved.join(source, "row_id", "left")
    checks = (
        (~F.col("original").eqNullSafe(F.col("current")), "ORIGINAL_CHANGED"),
        (F.coalesce(strip(F.col("proposed")), F.lit("")) == "", "PROPOSED_EMPTY"),
        (~F.col("identity").eqNullSafe(F.col("current_identity")), "IDENTITY_CHANGED"),
        (~F.col("proposed").eqNullSafe(recompute), "NOT_REPRODUCED"),
        (F.col("current").isNull(), "SOURCE_MISSING"),
    )
    out = joined.withColumn("failed", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks])))
    return out.withColumn("passed", F.size("failed") == 0)


def recheck_approved(queue: DataFrame) -> DataFrame:
    """Approved but unpublished rows: each check that fails is named."""
    checks = ((F.col("state") != "approved", "STATE"), (F.col("decision") != "approve", "DECISION"), (F.col("receipt").isNull(), "RECEIPT"), (~F.col("original").eqNullSafe(F.col("current_original")), "ORIGINAL"), (~F.col("proposed").eqNullSafe(F.col("current_proposed")), "PROPOSED"))
    return queue.withColumn("failed", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks])))


def import_queue(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, rejected): rows are known by a hash of their content; known ones and duplicates of one identity are refused."""
    hashed = rows.withColumn("content_hash", stable_id("Q", F.col("identity"), F.col("original"), F.col("proposed"), n=32))
    fresh = hashed.join(existing.select("content_hash").distinct(), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    counts = fresh.groupBy("identity").agg(F.count("*").alias("_n"))
    marked = fresh.join(counts, "identity")
    return marked.filter("_n = 1").drop("_n"), marked.filter("_n > 1").drop("_n").withColumn("reason", F.lit("duplicate_identity"))


def replayable(df: DataFrame, text: str, proposed: str, key: str, function=format_text) -> DataFrame:
    """Adds reproduced, idempotent and unique: f(text) = proposed, f(f(text)) = f(text), and one row for the key."""
    from pyspark.sql import Window

    once = function(F.col(text))
    return df.withColumns({"reproduced": once.eqNullSafe(F.col(proposed)), "idempotent": function(once).eqNullSafe(once), "unique": F.count("*").over(Window.partitionBy(key)) == 1})


def cluster_previews(rows: DataFrame, cluster: str, original: str, proposed: str, function=format_text) -> DataFrame:
    """Each cluster with its outcome and the distinct changes that it makes, bounded to the first twenty."""
    from pyspark.sql import Window

    ok = function(F.col(original)).eqNullSafe(F.col(proposed))
    distinct = rows.withColumn("_ok", ok).groupBy(cluster, original, proposed).agg(F.min("_ok").alias("_ok"), F.count("*").alias("c"))
    ranked = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(original, proposed)))
    pair = F.struct(F.col(original).alias("from"), F.col(proposed).alias("to"))
    return ranked.groupBy(cluster).agg(F.sum("c").alias("members"), F.when(F.min("_ok"), "pass").otherwise("fail").alias("outcome"), F.array_sort(F.collect_list(F.when(F.col("_r") <= 20, pair))).alias("pairs"))
