"""Streams: windows with watermarks, upserts by micro-batch, and state replay that folds a subject anew when a late fact comes.

The reference's surface is batch only; these carry the same operators over to Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from semforge.operators.states import GUARDS, STATES, TRANSITIONS, _fold


def windowed(events: DataFrame, time: str, keys: Sequence[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value in tumbling windows, or sliding ones with ``slide``; rows later than the watermark are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, keys: Sequence[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n"))


def upsert_stream(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``apply`` with its number, by which a repeated batch can be told."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_stream(facts: DataFrame, rules: Sequence[tuple] = TRANSITIONS, states: Sequence[str] = STATES) -> DataFrame:
    """(subject_key, state, version, late) of each subject that a micro-batch touches.

    The state store holds a subject's facts as (effective, recorded, source row, id, target, event, mapped); a late one goes to its place
    and the fold is done again.
    """
    names = ["subject_key", "effective_at", "recorded_at", "source_row_id", "fact_id", "to_state", "event_type", "mapped"]
    fold = _fold(rules, states, False)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        newest = max((h[0] for h in held if h[0] is not None), default=None)
        late = False
        for rows in batches:
            for r in rows[names[1:]].itertuples(index=False):
                effective = None if pd.isna(r.effective_at) else int(r.effective_at.value)
                late |= newest is not None and effective is not None and effective < newest
                held.append((effective, None if pd.isna(r.recorded_at) else int(r.recorded_at.value), r.source_row_id, r.fact_id, r.to_state, r.event_type, bool(r.mapped)))
        held = sorted(dict.fromkeys(held), key=lambda h: (h[0] is None, h[0] or 0, h[1] or 0, h[2] or "", h[3] or ""))
        state.update((held,))
        df = pd.DataFrame(held, columns=names[1:])
        df.insert(0, "subject_key", key[0])
        for c in ("effective_at", "recorded_at"):
            df[c] = pd.to_datetime(df[c])
        for g in GUARDS:
            df[g] = False
        done = pd.concat(fold(iter([df])))
        good = done[done.status == "accepted"]
        yield pd.DataFrame({"subject_key": [key[0]], "state": [good.to_state.iloc[-1] if len(good) else None], "version": [len(good)], "late": [late]})

    held = "facts array<struct<e:long,r:long,s:string,i:string,t:string,v:string,m:boolean>>"
    return facts.groupBy("subject_key").applyInPandasWithState(run, "subject_key string, state string, version long, late boolean", held, "update", GroupStateTimeout.NoTimeout)
