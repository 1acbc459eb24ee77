"""State replay: facts of a subject folded in effective order through transition rules.

Late rows are kept, flagged, and replayed in their place. What no rule accepts is a row for review and doesn't move the state. The fold is
a scan of composed maps, parallel over tasks and not over subjects alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semforge.functions.ids import stable_id
from semforge.storage import cut_lineage

#: States, and transitions as (from, event, to, priority, guard).
STATES = ("NEW", "PENDING", "PROCESSING", "RESOLVED", "CLOSED", "CANCELLED", "UNKNOWN")
TRANSITIONS = (
    (None, "DefectCreatedEvent", "NEW", 0, None),
    ("NEW", "DefectAcceptedEvent", "PENDING", 0, "review_accept_evidence"),
    ("PENDING", "DefectProcessingEvent", "PROCESSING", 0, "team_assignment_present"),
    ("PROCESSING", "ResolutionEvent", "RESOLVED", 0, "resolution_evidence_present"),
    ("RESOLVED", "DefectAcceptanceEvent", "CLOSED", 0, "acceptance_pass"),
    ("CLOSED", "DefectProcessingEvent", "PROCESSING", 1, "restore_event"),
    ("CANCELLED", "DefectProcessingEvent", "PROCESSING", 1, "restore_event"),
)
EVENT_TYPES = {"defect_created": "DefectCreatedEvent", "defect_accepted": "DefectAcceptedEvent", "defect_processing": "DefectProcessingEvent", "resolution": "ResolutionEvent", "defect_acceptance": "DefectAcceptanceEvent"}
GUARDS = ("team_assignment_present", "resolution_evidence_present", "acceptance_pass", "restore_event", "review_accept_evidence")


def event_type_of(event: Column, raw: Column) -> Column:
    """The event row's type, else that of the raw one, else the raw text in lower case."""
    low = F.nullif(F.lower(F.trim(raw)), F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    return F.coalesce(F.nullif(F.trim(event), F.lit("")), F.element_at(known, low), low)


def context_value(key: str, *layers: Column) -> Column:
    """A key of merged JSON objects; later layers win."""
    return F.coalesce(*[F.get_json_object(layer, f"$.{key}") for layer in reversed(layers)])


def guard_columns(context: Column, event_type: Column) -> dict[str, Column]:
    """What each guard that doesn't depend on the state says, as a boolean column; context is a JSON object."""

    def some(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.get_json_object(context, f"$.{k}")), F.lit("")) for k in keys]).isNotNull()

    accept = F.lower(F.coalesce(F.get_json_object(context, "$.status"), F.get_json_object(context, "$.raw_status"), F.lit("")))
    passed = F.lower(F.trim(F.coalesce(F.get_json_object(context, "$.acceptance_pass"), F.get_json_object(context, "$.acceptancePass"), F.lit(""))))
    kind = F.coalesce(event_type, F.lit(""))
    return {
        "team_assignment_present": some("team_id", "team_num", "teamId", "teamNum", "assigned_team"),
        "resolution_evidence_present": (kind == "ResolutionEvent") | some("resolution_id", "resolution_desc", "resolution_description", "resolutionId"),
        "acceptance_pass": passed.isin("true", "1", "yes", "pass", "passed"),
        "review_accept_evidence": kind.isin("DefectAcceptedEvent", "DefectAcceptanceEvent") | accept.rlike("accept|confirm|已确认|已接收"),
    }


def late_flags(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds late: some row of the subject has a strictly later effective and a strictly earlier recorded time."""
    micros = F.unix_micros(F.col("effective_at").cast("timestamp"))
    later = Window.partitionBy(*keys).orderBy("_micros").rangeBetween(1, Window.unboundedFollowing)
    out = rows.withColumn("_micros", micros).withColumn("_least", F.min("recorded_at").over(later))
    return out.withColumn("late", F.coalesce((F.col("_least") < F.col("recorded_at")) & F.col("_micros").isNotNull(), F.lit(False))).drop("_micros", "_least")


def _fold(rules: Sequence[tuple], states: Sequence[str], strict: bool):
    """The sequential fold over batches of sorted rows, for streams; ``replay_states`` is its parallel form."""
    known_events = {r[1] for r in rules}
    by_step: dict[tuple, list[tuple]] = {}
    for rule in sorted(rules, key=lambda r: -r[3]):
        by_step.setdefault((rule[1], rule[2]), []).append(rule)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, current = object(), None
        for rows in batches:
            timed = rows["effective_at"].notna().tolist()
            guards = {g: rows[g].tolist() for g in GUARDS}
            events = [None if pd.isna(x) else x for x in rows["event_type"]]
            out = []
            for i, (key, to, event, mapped) in enumerate(zip(rows["subject_key"], rows["to_state"], events, rows["mapped"], strict=True)):
                if key != subject:
                    subject, current = key, None
                fitting = [x for x in by_step.get((event, to), ()) if x[0] is None or x[0] == current]
                passing = False
                for rule in fitting:
                    if not strict or not rule[4]:
                        passing = True
                    elif rule[4] == "restore_event":
                        passing = current in ("CLOSED", "CANCELLED") and event == "DefectProcessingEvent"
                    else:
                        passing = bool(guards[rule[4]][i])
                    if passing:
                        break
                valid = to in states and timed[i]
                seed = current is None and valid and not fitting and event not in known_events and bool(mapped)
                accepted = valid and (passing or seed)
                if accepted:
                    reason = "approved_snapshot_seed" if seed else "accepted"
                elif not timed[i]:
                    reason = "missing_effective_at"
                else:
                    reason = "guard_failed" if fitting and not passing else "invalid_transition"
                out.append((current, "initial" if current is None else "replay" if current == to else "change", "accepted" if accepted else "needs_review", reason))
                if accepted:
                    current = to
            made = pd.DataFrame(out, columns=["from_state", "transition_type", "status", "reason"], index=rows.index)
            yield pd.concat([rows[["subject_key", "fact_id", "to_state", "event_type", "effective_at", "recorded_at"]], made], axis=1)[COLUMNS]

    return run


COLUMNS = ["subject_key", "fact_id", "from_state", "to_state", "event_type", "transition_type", "status", "reason", "effective_at", "recorded_at"]
ORDER = ("effective_at", "recorded_at")


def _judged(current: Column, rules: Sequence[tuple], states: Sequence[str], strict: bool) -> dict[str, Column]:
    """What the rules say of a fact in a state: whether one fits, one passes its guard, and whether the fact seeds the state."""
    event, to = F.coalesce("event_type", F.lit("")), F.col("to_state")
    fits = passes = F.lit(False)
    for from_, kind, target, _, guard in rules:
        here = (event == kind) & (to == target)
        here = here if from_ is None else here & current.eqNullSafe(F.lit(from_))
        fits = fits | here
        if strict and guard == "restore_event":
            here = here & F.coalesce(current.isin("CLOSED", "CANCELLED"), F.lit(False)) & (event == "DefectProcessingEvent")
        elif strict and guard:
            here = here & F.coalesce(F.col(guard), F.lit(False))
        passes = passes | here
    fits, passes = F.coalesce(fits, F.lit(False)), F.coalesce(passes, F.lit(False))
    valid = F.coalesce(to.isin(*states), F.lit(False)) & F.col("effective_at").isNotNull()
    seed = current.isNull() & valid & ~fits & ~event.isin(*sorted({r[1] for r in rules})) & F.coalesce("mapped", F.lit(False))
    return {"fits": fits, "passes": passes, "seed": seed, "accepted": valid & (passes | seed)}


def _letters(states: Sequence[str]) -> list[str]:
    """One letter for no state, then one for each state."""
    return [chr(48 + i) for i in range(len(states) + 1)]


def _prefixes(identity: str):
    """Adds to sorted facts the map from the state in which their partition began to the state before each fact.

    Only the first subject can have begun in an earlier partition; the others begin without a state, so their maps are constant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Maps and steps are few: each has a number, and what follows on a map by a step is worked out once.
        maps, numbers, steps, after = [identity], {identity: 0}, {}, [{}]

        def number(x: str) -> int:
            if x not in numbers:
                numbers[x] = len(maps)
                maps.append(x)
                after.append({})
            return numbers[x]

        fresh, running, subject, begun = number(identity[0] * len(identity)), 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, coded = batch.column("subject_key"), batch.column("step").dictionary_encode()
            named = [steps.setdefault(x, len(steps)) for x in coded.dictionary.to_pylist()]
            texts = list(steps)
            # Nulls are one subject, as they are one where the states are grouped.
            same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False)
            alike = pc.or_(same, pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1])))
            starts = [begun and keys[0].as_py() != subject, *pc.invert(alike).to_pylist()]
            out = []
            for new, code in zip(starts, coded.indices.to_pylist(), strict=True):
                if new:
                    running = fresh
                out.append(running)
                step = named[code]
                following = after[running].get(step)
                if following is None:
                    following = after[running][step] = number("".join(texts[step][ord(x) - 48] for x in maps[running]))
                running = following
            subject, begun = keys[-1].as_py(), True
            prefixes = pa.array(maps, pa.string()).take(pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, prefixes], [*batch.schema.names, "prefix"])

    return run


def _least(*values):
    return min((x for x in values if x is not None), default=None)


def _carried(parts: list, identity: str) -> list[tuple]:
    """For each partition (part, entry, next_effective, least_later, least_all): what its first and last subject share with its neighbours.

    ``entry`` is the state in which its first subject comes in. Of the last subject's facts in later partitions: the effective time of the
    first, the least recorded time of those after that time, and the least of all. One row of ``parts`` stands for one partition.
    """
    entries, running = [], identity[0]
    for before, x in zip([None, *parts], parts):
        entries.append(running if before is not None and before["last_subject"] == x["first_subject"] else identity[0])
        running = x["tail"][ord(entries[-1]) - 48]
    out, ahead = [], (None, None, None)
    for x, after, entry in zip(reversed(parts), [None, *reversed(parts)], reversed(entries)):
        if after is None or after["first_subject"] != x["last_subject"]:
            ahead = (None, None, None)
        else:
            time, later, every = ahead if after["first_subject"] == after["last_subject"] else (None, None, None)
            first = after["head_time"]
            strictly = _least(after["head_later"], later if time == first else every)
            ahead = (first if first is not None else time, strictly if first is not None else later, _least(after["head_all"], every))
        out.append((x["part"], entry, *ahead))
    return out


def replay_states(facts: DataFrame, rules: Sequence[tuple] = TRANSITIONS, states: Sequence[str] = STATES, scope: str | None = None, strict_guards: bool = False) -> tuple[DataFrame, DataFrame]:
    """(transitions, current) of facts (subject_key, fact_id, to_state, event_type, mapped, effective_at, recorded_at, source_row_id).

    Guard columns of the names in GUARDS count only with ``strict_guards``. Unknown times come last and are for review; ``scope`` replays
    one subject alone.

    A fact is a map of states, and maps compose: facts are sorted over all tasks by subject and time, each task composes the maps of its
    own, and one row for each task tells in which state the next one's first subject comes in. A subject with most of the facts is thus
    folded by many tasks. Whether a fact is late comes the same way, from the least recorded times that lie ahead.
    """
    rows = facts if scope is None else facts.filter(F.col("subject_key") == scope)
    for g in GUARDS:
        if g not in rows.columns:
            rows = rows.withColumn(g, F.lit(False))
    for c in ORDER:
        rows = rows.withColumn(c, F.col(c).cast("timestamp"))
    letters = _letters(states)
    to = F.coalesce(*[F.when(F.col("to_state") == s, x) for s, x in zip(states, letters[1:])], F.lit(letters[0]))
    steps = [F.when(_judged(F.lit(s).cast("string"), rules, states, strict_guards)["accepted"], to).otherwise(x) for s, x in zip((None, *states), letters)]
    kept = ["subject_key", "fact_id", "to_state", "event_type", "mapped", *ORDER, *(GUARDS if strict_guards else ())]
    order = [F.col("subject_key"), *[F.col(c).asc_nulls_last() for c in ORDER], F.col("source_row_id"), F.col("fact_id")]
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.withColumn("step", F.concat(*steps)).repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(*kept, "step")
    identity = "".join(letters)
    scanned = ranged.mapInArrow(_prefixes(identity), T.StructType([*ranged.schema.fields, T.StructField("prefix", T.StringType())]))
    stored = cut_lineage(scanned.withColumn("id", F.monotonically_increasing_id()), "replay").withColumn("part", F.shiftrightunsigned("id", 33))

    # One row for each task comes to the driver: its first and last subject, and what it has of the first.
    bounds = cut_lineage(stored.groupBy("part").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")), "bounds")
    at = F.broadcast(bounds.select(F.explode(F.array_distinct(F.array("first_id", "last_id"))).alias("id")))
    marks = cut_lineage(stored.join(at, "id").select("id", "subject_key", "prefix", "step"), "marks")
    first = marks.select(F.col("id").alias("first_id"), F.col("subject_key").alias("first_subject"))
    last = marks.select(F.col("id").alias("last_id"), F.col("subject_key").alias("last_subject"), "prefix", "step")
    ends = cut_lineage(bounds.join(first, "first_id").join(last, "last_id").select("part", "first_subject", "last_subject", "prefix", "step"), "ends")
    own = F.broadcast(ends.select(F.col("part").alias("p"), "first_subject"))
    head = stored.join(own, (F.col("part") == F.col("p")) & F.col("subject_key").eqNullSafe(F.col("first_subject"))).filter("effective_at IS NOT NULL")
    head = cut_lineage(head.select("part", *ORDER), "head")
    times = head.groupBy("part").agg(F.min("effective_at").alias("head_time"), F.min("recorded_at").alias("head_all"))
    later = head.join(F.broadcast(times.select("part", "head_time")), "part").filter(F.col("effective_at") > F.col("head_time")).groupBy("part").agg(F.min("recorded_at").alias("head_later"))
    ends = ends.join(times, "part", "left").join(later, "part", "left")
    parts = sorted((r.asDict() | {"tail": "".join(r["step"][ord(x) - 48] for x in r["prefix"])} for r in ends.collect()), key=lambda r: r["part"])
    last = {r["part"]: r["last_subject"] for r in parts}
    carried = [(part, entry, last[part], *ahead) for part, entry, *ahead in _carried(parts, identity)]
    known = rows.sparkSession.createDataFrame(carried, "part long, entry string, last_subject string, next_effective timestamp, least_later timestamp, least_all timestamp")

    joined = stored.join(F.broadcast(known), "part")
    index = F.expr("ascii(substring(prefix, ascii(entry) - 47, 1)) - 48")
    joined = joined.withColumn("from_state", F.get(F.array(F.lit(None).cast("string"), *map(F.lit, states)), index))
    here = _judged(F.col("from_state"), rules, states, strict_guards)
    reason = F.when(here["seed"] & here["accepted"], "approved_snapshot_seed").when(here["accepted"], "accepted").when(F.col("effective_at").isNull(), "missing_effective_at").when(here["fits"] & ~here["passes"], "guard_failed").otherwise("invalid_transition")
    kind = F.when(F.col("from_state").isNull(), "initial").when(F.col("from_state") == F.col("to_state"), "replay").otherwise("change")
    judged = joined.withColumns({"transition_type": kind, "status": F.when(here["accepted"], "accepted").otherwise("needs_review"), "reason": reason})
    # Facts with a later time within the task, and what later tasks have of the subject.
    ahead = Window.partitionBy("part", "subject_key").orderBy(F.unix_micros("effective_at")).rangeBetween(1, Window.unboundedFollowing)
    beyond = F.when(F.col("subject_key").eqNullSafe(F.col("last_subject")), F.when(F.col("effective_at") < F.col("next_effective"), F.col("least_all")).otherwise(F.col("least_later")))
    least = F.least(F.min("recorded_at").over(ahead), beyond)
    out = judged.withColumn("late", F.coalesce((least < F.col("recorded_at")) & F.col("effective_at").isNotNull(), F.lit(False)))
    out = out.select(*COLUMNS, "late", stable_id("TRN", F.col("subject_key"), F.col("fact_id"), F.col("to_state")).alias("transition_id"))
    return out, current_states(out)


def current_states(transitions: DataFrame) -> DataFrame:
    """(subject_key, state, effective_at, version, fact_id): the last accepted transition and how many there were."""
    return folded_states(transitions).filter("version > 0")


def folded_states(transitions: DataFrame) -> DataFrame:
    """The same of every subject; one without an accepted transition has version 0 and no state."""
    accepted = F.col("status") == "accepted"
    last = F.max(F.when(accepted, F.struct("effective_at", "recorded_at", "fact_id", "to_state")))
    return transitions.groupBy("subject_key").agg(last.alias("l"), F.count_if(accepted).alias("version")).select("subject_key", F.col("l.to_state").alias("state"), F.col("l.effective_at").alias("effective_at"), "version", F.col("l.fact_id").alias("fact_id"))


def recompute_scope(old: DataFrame, new: DataFrame, subjects: Sequence[str], key: str = "subject_key") -> DataFrame:
    """States after a replay of some subjects alone: their old rows go, whatever the replay gives takes their place, all others stay."""
    inside = F.coalesce(F.col(key).isin(*subjects), F.lit(False))
    return old.filter(~inside).unionByName(new.filter(inside))


def run_status(transitions: DataFrame, states: Sequence[str] = STATES) -> str:
    if not states:
        return "blocked"
    return "needs_review" if transitions.filter("status = 'needs_review'").limit(1).count() else "completed"


def diff_states(old: DataFrame, new: DataFrame, key: str = "subject_key") -> DataFrame:
    """(key, change) of states (key, state, effective_at): added, removed, state_changed or effective_time_changed; equal ones absent."""
    a = old.select(F.col(key).alias("_ka"), F.col("state").alias("_sa"), F.col("effective_at").alias("_ea"))
    b = new.select(F.col(key).alias("_kb"), F.col("state").alias("_sb"), F.col("effective_at").alias("_eb"))
    change = F.when(F.col("_ka").isNull(), "added").when(F.col("_kb").isNull(), "removed").when(~F.col("_sa").eqNullSafe(F.col("_sb")), "state_changed").when(~F.col("_ea").eqNullSafe(F.col("_eb")), "effective_time_changed")
    return a.join(b, F.col("_ka") == F.col("_kb"), "full_outer").select(F.coalesce("_ka", "_kb").alias(key), change.alias("change"), F.col("_sa").alias("old_state"), F.col("_sb").alias("new_state")).filter("change IS NOT NULL")
