"""Description cleaning: candidates, their context, exclusions, classes of difference, previews. Every row that leaves has a reason."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semforge.functions.ids import stable_id
from semforge.functions.text import GENERIC_TERMS, blank_to_null, first_non_blank, is_code_only, is_generic, is_placeholder, jaccard, ngrams, nfkc, normalize, strip
from semforge.operators.reads import INACTIVE
from semforge.operators.sampling import round_robin

MOST_CHARS = 500


def _codes(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]))


def base_candidates(rows: DataFrame) -> DataFrame:
    """Rows (row_id, site, asset, description, status) to candidates: blocked without identity, for review without a usable text."""
    text = normalize(F.col("description"), "candidate")
    blocked = _codes((blank_to_null(F.col("site")).isNull(), "SITE_MISSING"), (blank_to_null(F.col("asset")).isNull(), "ASSET_MISSING"))
    review = _codes((text == "", "DESCRIPTION_EMPTY"), (is_placeholder(F.col("description")), "PLACEHOLDER"), (F.coalesce(F.col("status").isin(*INACTIVE), F.lit(False)), "STOPPED_DEVICE"))
    state = F.when(F.size(blocked) > 0, "blocked").when(F.size(review) > 0, "needs_review").otherwise("candidate")
    return rows.withColumns({"candidate_text": text, "reason_codes": F.concat(blocked, review), "state": state, "candidate_id": stable_id("CAN", F.col("site"), F.col("asset"), F.col("description"))})


def context_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with looked-up context (location_name, hierarchy, class_id, classification, n_specs, n_children): complete, or the reasons why not."""
    reasons = _codes((F.col("location").isNull(), "LOCATION_BLANK"), (F.col("location").isNotNull() & F.col("location_name").isNull(), "LOCATION_NOT_FOUND"), (F.col("hierarchy").isNull(), "HIERARCHY_MISSING"), (F.col("class_id").isNull(), "CLASS_MISSING"), (F.col("class_id").isNotNull() & F.col("classification").isNull(), "CLASSIFICATION_NOT_FOUND"), (F.coalesce("n_specs", F.lit(0)) == 0, "SPECIFICATION_MISSING"))
    out = candidates.withColumn("context_reasons", reasons)
    return out.withColumns({"context_status": F.when(F.size("context_reasons") == 0, "complete").otherwise("needs_review"), "context_hash": stable_id("CTX", *[F.col(c) for c in ("location", "location_name", "hierarchy", "class_id", "classification", "n_specs")], n=32)})


def exclusion_chain(rows: DataFrame, steps: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): a row leaves at the first step whose condition holds, with that step's name; the two add up to the input."""
    reason = reduce(lambda c, s: c.when(F.coalesce(s[1], F.lit(False)), s[0]), steps, F.when(F.lit(False), ""))
    marked = rows.withColumn("exclusion_reason", reason)
    return marked.filter("exclusion_reason IS NULL").drop("exclusion_reason"), marked.filter("exclusion_reason IS NOT NULL")


def semantic_candidates(rows: DataFrame, terms: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Rows (candidate_id, site, asset, original, candidate, context_valid, location_name, classification) to proposals.

    Confirmed terms (source, target, id) are replaced in order after normalisation. Eight failures send a row to review; two kinds of
    context make strong evidence, one makes weak.
    """
    base = normalize(F.coalesce(blank_to_null(F.col("candidate")), F.col("original")), "candidate")
    text = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), terms, base)
    applied = _codes(*[(base.contains(a), i) for a, _, i in terms]) if terms else F.array().cast("array<string>")
    out = rows.withColumns({"proposed": text, "applied_terms": applied})
    p = F.col("proposed")
    reasons = _codes(
        (blank_to_null(F.col("candidate_id")).isNull(), "CANDIDATE_ID_MISSING"),
        (blank_to_null(F.col("site")).isNull() | blank_to_null(F.col("asset")).isNull(), "IDENTITY_MISSING"),
        (p == "", "DESCRIPTION_EMPTY"),
        (is_code_only(p), "CODE_ONLY"),
        (is_generic(p), "GENERIC_TERM"),
        (F.length(p) > MOST_CHARS, "TOO_LONG"),
        (~F.coalesce(F.col("context_valid"), F.lit(False)), "CONTEXT_INVALID"),
        (F.length(p) < 2, "TOO_SHORT"),
    )
    n = F.col("location_name").isNotNull().cast("int") + F.col("classification").isNotNull().cast("int")
    level = F.when(n == 2, "strong").when(n == 1, "weak").otherwise("none")
    out = out.withColumns({"reason_codes": F.array_distinct(reasons), "evidence_level": level})
    ok = F.size("reason_codes") == 0
    return out.withColumns({"status": F.when(ok, "candidate").otherwise("needs_review"), "confidence": F.when(ok & (F.col("evidence_level") == "strong"), "high").when(ok, "medium").otherwise("low"), "candidate_hash": stable_id("SEM", F.col("candidate_id"), F.col("original"), p, n=32)})


def difference_class(asset: Column, location: Column) -> Column:
    """struct(difference, score, action): containment first, then shared bigrams."""
    a, b = normalize(asset, "comparison"), normalize(location, "comparison")
    score = jaccard(ngrams(a), ngrams(b))

    def out(name: str, s: Column, action: str) -> Column:
        return F.struct(F.lit(name).alias("difference"), s.cast("double").alias("score"), F.lit(action).alias("action"))

    keep, both, later = "KEEP_DEVICE_DESCRIPTION_AND_LOCATION_CONTEXT", "KEEP_BOTH_DESCRIPTIONS_SEPARATELY", "DO_NOT_REWRITE_ROUTE_TO_REVIEW_LATER"
    return (
        F.when((a == "") | (b == ""), out("NOT_COMPARABLE", F.lit(0.0), later))
        .when(a.contains(b) & (a != b), out("DEVICE_DESCRIPTION_CONTAINS_LOCATION", F.lit(1.0), keep))
        .when(b.contains(a) & (a != b), out("LOCATION_DESCRIPTION_CONTAINS_DEVICE", F.lit(1.0), keep))
        .when(score >= 0.5, out("HIGH_TEXT_OVERLAP", score, both))
        .when(score >= 0.2, out("PARTIAL_TEXT_OVERLAP", score, both))
        .otherwise(out("LOW_TEXT_OVERLAP", score, later))
    )


def relationship_class(asset: Column, location: Column) -> Column:
    a, b = normalize(asset, "comparison"), normalize(location, "comparison")
    return F.when((a == "") | (b == ""), "NOT_COMPARABLE").when(a == b, "EXACT_NORMALIZED").otherwise("DIFFERENT_DESCRIPTIONS")


def quality_flags(text: Column) -> Column:
    """Empty, code only, general, too short and too long."""
    x = strip(F.coalesce(text, F.lit("")))
    return _codes((x == "", "EMPTY"), (is_code_only(x), "CODE_ONLY"), (x.isin(*GENERIC_TERMS), "GENERIC"), ((F.length(x) > 0) & (F.length(x) < 3), "TOO_SHORT"), (F.length(x) > 100, "TOO_LONG"))


def mine_terms(attributes: DataFrame, classifications: DataFrame, domains: DataFrame) -> DataFrame:
    """Terminology candidates of three catalogues (table, key, and labels title, alias, attribute, column): one for each term."""

    def of(kind: str, df: DataFrame) -> DataFrame:
        label = first_non_blank(*[F.col(c) for c in ("title", "alias", "attribute", "column") if c in df.columns])
        out = df.select(F.lit(kind).alias("kind"), F.col("table_name"), F.col("key"), label.alias("term")).filter("term IS NOT NULL")
        return out.withColumns({"term_id": stable_id("TERM", F.col("kind"), F.col("table_name"), F.col("key"), F.col("term")), "status": F.lit("candidate")})

    return of("attribute", attributes).unionByName(of("classification", classifications)).unionByName(of("domain", domains)).dropDuplicates(["term_id"])


def cluster_class(original: Column, proposed: Column) -> Column:
    """struct(cluster, confidence) of a change: about a question mark, a leading minus, a hyphen at the end, or other."""

    def out(name: str, c: float) -> Column:
        return F.struct(F.lit(name).alias("cluster"), F.lit(c).alias("confidence"))

    minus = original.rlike(r"^\s*[-−－][0-9]")
    hyphen = original.rlike(r"[-－]\s*$") & ~proposed.rlike(r"[-－]\s*$")
    return F.when(original.rlike("[?？]"), out("question_context", 0.5)).when(minus, out("leading_minus", 0.6)).when(hyphen, out("terminal_hyphen", 0.9)).otherwise(out("other", 0.4))


def judge_deferred(original: Column, proposed: Column) -> Column:
    """What a deferred change is: a lost sign, a safe mapping, punctuation at the end, a Roman numeral, a question, or other."""
    lost_sign = original.rlike(r"(^|[^0-9A-Za-z])[-+][0-9]") & ~proposed.rlike(r"(^|[^0-9A-Za-z])[-+][0-9]")
    return F.when(lost_sign, "keep_original_sign_deleted").when(nfkc(original) == proposed, "approve_safe_mapping").when(F.regexp_replace(original, r"[。.，,;；、\-]+$", "") == proposed, "approve_terminal_punctuation").when(original.rlike("[Ⅰ-Ⅻⅰ-ⅻ]"), "review_roman_numeral").when(original.rlike("[?？]"), "review_question").otherwise("review_other")


def preview_risk(original: Column, proposed: Column) -> Column:
    """whitespace_only where the texts agree but for blanks, else semantic."""
    return F.when(F.regexp_replace(original, r"(?U)[\s　]+", "") == F.regexp_replace(proposed, r"(?U)[\s　]+", ""), "whitespace_only").otherwise("semantic")


def preview(rows: DataFrame, text: str, function, strata: Sequence[str], order: Sequence[str], n: int | None = None, exclude: str | None = None) -> DataFrame:
    """Rows that a format rule changes, with what they would become; none that is emptied; a stratified sample where asked for.

    The five previews of format rules differ in ``function`` and ``exclude`` alone.
    """
    proposed = function(F.col(text))
    out = rows if exclude is None else rows.filter(~F.coalesce(F.col(text).rlike(exclude), F.lit(False)))
    out = out.withColumn("proposed", proposed).filter((F.col("proposed") != F.col(text)) & (F.col("proposed") != ""))
    out = out.withColumn("row_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return out if n is None else round_robin(out, strata, order, n)
