"""The change detector: one state a recording, from ordered observations to interval events, in batch and in streams.

An observation has a key, a time and scores already computed from frames; a frame reference is carried along. The first
one emits `initial`. Then the first rule that holds wins: changed, with `motion` every few seconds of it; dirty and quiet
for a while emits `stable` with the last moving frame; clean and long silent emits `heartbeat`.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

EVENT = "key long, kind string, started_at double, ended_at double, frame long, change_score double"
STATE = "last_motion double, last_emit double, last_checkpoint double, started double, peak double, dirty boolean, frame long"


@dataclasses.dataclass(frozen=True)
class Rules:
    stable_seconds: float = 1.5
    heartbeat_seconds: float = 60.0
    motion_seconds: float = 5.0
    change: float = 0.007
    watch_change: float = 0.003


@dataclasses.dataclass
class State:
    last_motion: float | None = None
    last_emit: float | None = None
    last_checkpoint: float | None = None
    started: float | None = None
    peak: float = 0.0
    dirty: bool = False
    frame: int | None = None


def observe(state: State | None, rules: Rules, at: float, score: float, watch: float, frame: int) -> tuple[State, tuple | None]:
    """The state after an observation, and (kind, started_at, ended_at, frame, change_score) if it emits."""
    if state is None:
        return State(last_emit=at, last_checkpoint=at, started=at, frame=frame), ("initial", at, at, frame, 1.0)
    s = state
    if score >= rules.change or watch >= rules.watch_change:
        if not s.dirty:
            s.last_checkpoint = at
        s.dirty, s.frame, s.last_motion, s.peak = True, frame, at, max(s.peak, score, watch)
        if at - s.last_checkpoint >= rules.motion_seconds:
            s.last_checkpoint = s.last_emit = at
            return s, ("motion", s.started, at, frame, s.peak)
        return s, None
    if s.dirty:
        if at - s.last_motion < rules.stable_seconds:
            return s, None
        event = ("stable", s.started, at, s.frame, s.peak)
        s.dirty, s.peak = False, 0.0
    elif at - s.last_emit >= rules.heartbeat_seconds:
        event = ("heartbeat", s.started, at, frame, s.peak)
    else:
        return s, None
    s.last_emit = s.started = at
    return s, event


COLUMNS = ["key", "kind", "started_at", "ended_at", "frame", "change_score"]


def detect(observations: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Events of a table (key, at, score, watch, frame). Sorted partitions are streamed, so a recording may be of any length."""

    def run(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for k, at, score, watch, frame in zip(*(pdf[c] for c in ("key", "at", "score", "watch", "frame")), strict=True):
                if k != key:
                    key, state = k, None
                state, event = observe(state, rules, at, score, watch, int(frame))
                if event:
                    out.append((k, *event))
            yield pd.DataFrame(out, columns=COLUMNS)

    rows = observations.select("key", "at", "score", F.coalesce("watch", F.lit(0.0)).alias("watch"), "frame")
    return rows.repartition("key").sortWithinPartitions("key", "at", "frame").mapInPandas(run, EVENT)


def detect_stream(observations: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same over a stream; state lives in the state store. No timers: a heartbeat needs an observation."""

    def run(key, batches: Iterator[pd.DataFrame], store):
        state = State(*store.get) if store.exists else None
        pdf = pd.concat(list(batches)).sort_values(["at", "frame"], kind="stable")
        out = []
        for at, score, watch, frame in zip(*(pdf[c] for c in ("at", "score", "watch", "frame")), strict=True):
            state, event = observe(state, rules, at, score, 0.0 if pd.isna(watch) else watch, int(frame))
            if event:
                out.append((key[0], *event))
        if state is not None:
            store.update(dataclasses.astuple(state))
        yield pd.DataFrame(out, columns=COLUMNS)

    grouped = observations.select("key", "at", "score", "watch", "frame").groupBy("key")
    return grouped.applyInPandasWithState(run, EVENT, STATE, "append", "NoTimeout")


def downsampled(observations: DataFrame, fps: float) -> DataFrame:
    """The first observation of each 1/fps seconds of a key."""
    slot = F.floor(F.col("at") * fps)
    first = observations.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("at", "frame", "score", "watch")).alias("o"))
    return first.select("key", "o.*")


def newest(batch: DataFrame, size: int = 8) -> tuple[DataFrame, int]:
    """The newest rows of a micro-batch and how many older ones were dropped, like a bounded queue."""
    total = batch.count()
    return batch.orderBy(F.desc("at")).limit(size), max(0, total - size)


def with_manual(events: DataFrame, control: DataFrame) -> DataFrame:
    """Detector events and manual ones (key, at, frame), which have score 0 and leave the detector alone."""
    manual = control.select("key", F.lit("manual").alias("kind"), F.col("at").alias("started_at"), F.col("at").alias("ended_at"), "frame", F.lit(0.0).alias("change_score"))
    return events.unionByName(manual)


