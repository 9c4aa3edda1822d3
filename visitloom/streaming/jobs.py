"""Streaming forms of the batch operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from visitloom.operators.timeline import keep_samples
from visitloom.scratch import Rounds
from visitloom.session import ship


def sessions(visits: DataFrame, gap: int = 300, by: tuple[str, ...] = ("actor",), late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of visits (started_at as timestamp, seconds): frontier rule by dynamic gaps.

    A window that lasts a visit's own length and the gap beyond its start merges with the next
    exactly when that starts within the gap of the frontier. Output is final sessions (append).
    """
    window = F.session_window("started_at", F.concat((F.col("seconds") + gap).cast("string"), F.lit(" seconds")))
    told = visits.withWatermark("started_at", late).groupBy(*by, window.alias("w")).agg(F.count("*").alias("n_visits"), F.sum("seconds").alias("played_seconds"))
    return told.select(*by, F.col("w.start").alias("started_at"), (F.col("w.end") - F.expr(f"interval {gap} seconds")).alias("ended_at"), "n_visits", "played_seconds")


def sampled(positions: DataFrame, every: int, by: str = "log") -> DataFrame:
    """Down-sampled positions of a stream; the last kept point of each log is its only state."""
    ship(positions.sparkSession)
    columns = positions.columns

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["at_ms", "place"], kind="stable")
        kept, last = keep_samples(pdf["at_ms"].to_numpy(), pdf["place"].to_numpy(), last, every)
        if last is not None:
            state.update((int(last[0]), str(last[1])))
        yield pdf.iloc[kept][columns]

    return positions.groupBy(by).applyInPandasWithState(fold, positions.schema, "at_ms long, place string", "append", GroupStateTimeout.NoTimeout)


def merging(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run ``merge(batch, batch_id)`` on every micro-batch; merges are idempotent, so replays are safe.

    Late facts are linked by a later merge instead of falling behind a watermark.
    """
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def drained(stream: DataFrame, label: str) -> DataFrame:
    """All that a stream over present files yields, written as Parquet in the shared folder and read back."""
    spark = stream.sparkSession
    root = Rounds(spark, label).root  # goes when the driver's Python ends
    writer = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def fights(marks: DataFrame, by: str = "log") -> DataFrame:
    """Fights of a stream of START and END marks, by operators.timeline.folded_fights' rule.

    A row is put out when a fight opens (ended_at null) and again when it closes, under the same
    line_no; a sink that merges by (log, line_no) holds the newest. An END without a START stands by
    its own line. The open fights of a log are its only state, so a mark may come batches later.
    """
    ship(marks.sparkSession)
    schema = f"{by} string, kind string, encounter_id long, line_no long, started_at long, ended_at long, success boolean"

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = json.loads(state.get[0]) if state.exists else {}
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values("line_no", kind="stable")
        told: dict[int, tuple] = {}
        for r in pdf.itertuples(index=False):  # a handful of marks a log and batch
            encounter = None if pd.isna(r.encounter_id) else int(r.encounter_id)
            stack = opened.setdefault(json.dumps([r.kind, encounter]), [])
            if r.mark == "START":
                stack.append([int(r.line_no), int(r.at)])
                told[int(r.line_no)] = (key[0], r.kind, encounter, int(r.line_no), int(r.at), None, None)
            else:
                line, began = stack.pop() if stack else (int(r.line_no), None)
                told[line] = (key[0], r.kind, encounter, line, began, int(r.at), None if pd.isna(r.success) else bool(r.success))
        state.update((json.dumps({k: v for k, v in opened.items() if v}),))
        out = pd.DataFrame(list(told.values()), columns=[by, "kind", "encounter_id", "line_no", "started_at", "ended_at", "success"])
        yield out.astype({"encounter_id": "Int64", "line_no": "Int64", "started_at": "Int64", "ended_at": "Int64", "success": "boolean"})

    return marks.groupBy(by).applyInPandasWithState(fold, schema, "opened string", "append", GroupStateTimeout.NoTimeout)


def tracked(events: DataFrame, identity: list[str], by: str = "actor") -> DataFrame:
    """Finished visits of a stream of events, by operators.timeline.tracked's rule.

    A visit ends when who, where or how changes; the one going on is each actor's only state. Visits
    in which nothing happened (weight 0) are not put out. Events of one actor come in order.
    """
    ship(events.sparkSession)
    names = [c for c in identity if c != by]
    schema = f"{by} long, " + ", ".join(f"{c} string" for c in names) + ", started_at long, ended_at long, n_events long, weight long"

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # arrays, not frames: most keys have a few rows a batch, and a frame's operations cost a millisecond each
        pdf = pd.concat(list(pdfs), ignore_index=True)
        order = np.lexsort((pdf["event_id"].to_numpy(), pdf["at"].to_numpy()))
        at, weight = pdf["at"].to_numpy()[order], pdf["weight"].fillna(0).to_numpy()[order]
        told = [[None if pd.isna(v) else v for v in pdf[c].to_numpy(dtype=object)[order]] for c in names]
        keys = list(zip(*told, strict=True)) if names else [()] * len(at)
        starts = np.array([i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]])
        ends = np.append(starts[1:], len(at))
        parts = zip(at[starts], at[ends - 1], ends - starts, np.add.reduceat(weight, starts), strict=True)
        rows = [[list(keys[i]), *map(int, p)] for i, p in zip(starts, parts, strict=True)]
        if state.exists:
            before = json.loads(state.get[0])
            if before[0] == rows[0][0]:
                rows[0] = [before[0], min(before[1], rows[0][1]), max(before[2], rows[0][2]), before[3] + rows[0][3], before[4] + rows[0][4]]
            else:
                rows.insert(0, before)
        state.update((json.dumps(rows[-1], default=str),))
        done = [[key[0], *r[0], *r[1:]] for r in rows[:-1] if r[4] > 0]
        yield pd.DataFrame(done, columns=[by, *names, "started_at", "ended_at", "n_events", "weight"])

    return events.groupBy(by).applyInPandasWithState(fold, schema, "visit string", "append", GroupStateTimeout.NoTimeout)


def counter_gains(readings: DataFrame, by: str, value: str = "held") -> DataFrame:
    """What counters of a stream gained batch by batch: (by, gained, total, at, event_id).

    A sink adds up what is gained and holds the total of the latest (at, event_id). The first sight of a
    counter is its baseline; the last total is its only state.
    """
    ship(readings.sparkSession)

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["at", "event_id"], kind="stable")
        held = pdf[value].to_numpy()
        before = state.get[0] if state.exists else held[0]
        rises = np.diff(np.concatenate([[before], held]))
        state.update((int(held[-1]),))
        last = {c: [int(pdf[c].iloc[-1])] for c in ("at", "event_id")}
        yield pd.DataFrame({by: [key[0]], "gained": [int(rises[rises > 0].sum())], "total": [int(held[-1])], **last})

    return readings.groupBy(by).applyInPandasWithState(fold, f"{by} long, gained long, total long, at long, event_id long", "total long", "append", GroupStateTimeout.NoTimeout)
