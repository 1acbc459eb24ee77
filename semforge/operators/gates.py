"""Gates around proposals, reviews, approvals and releases: each names what failed, and a second run changes nothing."""

from __future__ import annotations

import time
from collections import Counter, defaultdict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semforge.functions.ids import content_hash, stable_id
from semforge.functions.text import blank_to_null, nfkc
from semforge.operators.reads import BLOCKING, STRONG_EVIDENCE, has_code
from semforge.operators.rules import Rule
from semforge.storage import spread

LEAST_CONFIDENCE = 0.85
#: Other spellings of verdicts, and ranks of risks.
VERDICTS = {"approve": "approve", "approved": "approve", "pass": "approve", "accept": "approve", "reject": "reject", "rejected": "reject", "isolate": "isolate", "defer": "defer", "needs_review": "needs_review", "review": "needs_review"}
RISKS = ("low", "medium", "high")


def failed(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that don't hold; one that can't be told doesn't."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]))


def rule_from_proposal(proposal: Mapping) -> Rule:
    """A Rule of a proposal; one outside the vocabulary is refused with the reason."""
    clusters = list(dict.fromkeys(proposal.get("clusterKeys") or proposal.get("cluster_keys") or []))
    rule = Rule(str(proposal.get("ruleId") or proposal.get("rule_id") or content_hash(proposal)[:12]), str(proposal.get("operation", "")).strip().lower(), dict(proposal.get("condition") or {}), dict(proposal.get("parameters") or {}), dict(proposal.get("scope") or {}))
    return rule if not clusters else Rule(rule.rule_id, rule.operation, rule.condition, rule.parameters | {"clusters": clusters}, rule.scope)


def verdict_gate(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with verdicts (candidate_id, verdict, confidence, position): the first of each counts, none means review.

    approve only where verdict, confidence and the row's own evidence agree; ``failed_checks`` names the others.
    """
    known = F.element_at(F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv]), F.lower(F.trim("verdict")))
    first = verdicts.withColumn("_r", F.row_number().over(Window.partitionBy("candidate_id").orderBy("position"))).filter("_r = 1").select("candidate_id", F.coalesce(known, F.lit("needs_review")).alias("model_verdict"), F.col("confidence").alias("model_confidence"))
    out = candidates.join(first, "candidate_id", "left")
    checks = failed(
        (F.col("model_verdict") == "approve", "VERDICT"),
        (F.col("model_confidence") >= LEAST_CONFIDENCE, "CONFIDENCE"),
        ((F.col("status") == "candidate") & (F.col("confidence") == "high"), "CANDIDATE"),
        (F.col("evidence_level").isin(*STRONG_EVIDENCE), "EVIDENCE"),
        (~has_code(F.col("reason_codes"), *BLOCKING), "CONFLICT"),
        (blank_to_null(F.col("proposed")).isNotNull(), "EMPTY"),
        (F.array_contains("reason_codes", "replay_passed"), "REPLAY"),
        (F.array_contains("reason_codes", "source_identity_verified"), "IDENTITY"),
    )
    return out.withColumn("failed_checks", checks).withColumn("decision", F.when(F.size("failed_checks") == 0, "approve").when(F.col("model_verdict").isin("reject", "isolate", "defer"), F.col("model_verdict")).otherwise("needs_review"))


def catalog_gate(verdicts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Verdicts (pattern_key, risk, confidence) bound to mined rules: the higher risk and the lower confidence count; duplicates and unknown patterns are rejected."""

    def rank(c: str) -> Column:
        return F.coalesce(F.array_position(F.array(*map(F.lit, RISKS)), F.col(c)), F.lit(0))

    numbered = verdicts.withColumn("_n", F.row_number().over(Window.partitionBy("pattern_key").orderBy(F.desc("confidence"), "risk")))
    joined = numbered.select("pattern_key", F.col("risk").alias("v_risk"), F.col("confidence").alias("v_conf"), "_n").join(catalog, "pattern_key", "left")
    risk = F.element_at(F.array(*map(F.lit, RISKS)), F.greatest(rank("v_risk"), rank("risk"), F.lit(1)).cast("int"))
    outcome = F.when(F.col("rule_id").isNull(), "unknown_pattern").when(F.col("_n") > 1, "duplicate").otherwise("bound")
    return joined.select("pattern_key", "rule_id", F.when(F.col("rule_id").isNotNull(), risk).alias("risk"), F.least("v_conf", "confidence").alias("confidence"), outcome.alias("outcome"))


def draft_gate(drafts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Drafts (draft_id, cluster_id, source, target, confidence) against clusters (cluster_id, signature): reasons to refuse each."""
    out = drafts.join(clusters, "cluster_id", "left")
    chars = F.filter(F.split("source", ""), lambda c: c != "")
    reasons = failed((F.col("signature").isNotNull(), "UNKNOWN_CLUSTER"), (F.forall(chars, lambda c: F.col("signature").contains(c)), "CHARACTERS_OUTSIDE_SIGNATURE"), (nfkc(F.col("source")) == F.col("target"), "NOT_REPLAYABLE"), (F.col("confidence") >= LEAST_CONFIDENCE, "CONFIDENCE"))
    return out.withColumn("reasons", reasons)


def judged_reviews(reviews: DataFrame, candidates: DataFrame, receipts: DataFrame) -> DataFrame:
    """Submissions (request_key, candidate_id, decision, note, description) with ``reasons``: the preconditions of a review that they fail."""
    done = receipts.select("request_key").distinct().withColumn("_done", F.lit(True))
    out = spread(reviews, "candidate_id").join(spread(candidates.select("candidate_id", "review_state", "validator_status"), "candidate_id"), "candidate_id", "left")
    out = spread(out, "request_key").join(spread(done, "request_key"), "request_key", "left")
    reasons = failed(
        (F.col("_done").isNull(), "ALREADY_RECORDED"),
        (F.col("review_state").isNotNull(), "UNKNOWN_CANDIDATE"),
        (F.col("review_state") == "pending", "NOT_PENDING"),
        (F.col("decision").isin("approve", "reject", "defer", "isolate"), "UNKNOWN_DECISION"),
        ((F.col("decision") != "approve") | (F.col("validator_status") == "pass"), "VALIDATION_FAILED"),
        ((F.col("decision") == "approve") | blank_to_null(F.col("note")).isNotNull(), "NOTE_MISSING"),
        ((F.col("decision") != "approve") | blank_to_null(F.col("description")).isNotNull(), "DESCRIPTION_MISSING"),
    )
    return out.withColumn("reasons", reasons)


def review_gate(reviews: DataFrame, candidates: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) submissions under the preconditions of a review, as ``judged_reviews`` finds them."""
    out = judged_reviews(reviews, candidates, receipts)
    return out.filter(F.size("reasons") == 0), out.filter(F.size("reasons") > 0)


def record_once(ledger: DataFrame, new: DataFrame, key: str = "request_key") -> DataFrame:
    """The ledger with rows whose key it hasn't; a key given twice at once is recorded once."""
    fresh = new.dropDuplicates([key]).join(ledger.select(key).distinct(), key, "left_anti")
    return ledger.unionByName(fresh.select(ledger.columns))


def publish(queue: DataFrame, published: DataFrame) -> DataFrame:
    """Publications of approved rows that have none; the id comes from the row, so a second run publishes nothing."""
    rows = queue.filter("state = 'approved' AND replay_status = 'passed'").withColumn("publication_id", stable_id("PUB", F.col("candidate_id"), F.col("proposed")))
    return rows.join(published.select("publication_id"), "publication_id", "left_anti").select("publication_id", "candidate_id", "original", "proposed", F.lit(False).alias("source_write"))


def auto_approve(candidates: DataFrame, eligible: Callable[[DataFrame], DataFrame], samples: DataFrame, run_key: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, finished samples) of one run: pending candidates that are eligible; a sample is finished when none of it waits."""
    hit = eligible(candidates.filter("review_state = 'pending'")).select("candidate_id")
    reviews = hit.select(stable_id("REV", F.lit(run_key), F.col("candidate_id")).alias("request_key"), "candidate_id", F.lit("approve").alias("decision"))
    waiting = candidates.filter("review_state = 'pending'").join(hit, "candidate_id", "left_anti").select("candidate_id")
    open_ = samples.join(waiting, "candidate_id", "left_semi").select("sample_id").distinct()
    return reviews, samples.select("sample_id").distinct().join(open_, "sample_id", "left_anti")


class Metrics:
    """Counters and timings of a process, as the metrics page shows them."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.times: dict[str, list[float]] = defaultdict(list)

    def count(self, name: str, n: int = 1) -> None:
        self.counts[name] += n

    def timed(self, name: str, function: Callable, *args: object) -> object:
        started = time.perf_counter()
        try:
            return function(*args)
        finally:
            self.times[name].append(time.perf_counter() - started)

    def summary(self) -> dict:
        return {"counts": dict(self.counts), "times": {k: {"n": len(v), "mean": sum(v) / len(v), "max": max(v)} for k, v in self.times.items()}}


def safe_result(result: Mapping) -> Mapping:
    """A step's result, if it neither wrote to a source nor published: both flags must be false or absent."""
    for flag in ("source_write", "formal_publication", "sourceWrite", "formalPublication"):
        if result.get(flag):
            raise ValueError(f"{flag} must be false")
    return result


def publish_gate(rows: Sequence[Mapping]) -> list[str]:
    """Ids of rows that may not be published, for small batches on the driver."""
    return [str(r["candidate_id"]) for r in rows if r.get("state") != "approved" or not str(r.get("proposed") or "").strip()]
