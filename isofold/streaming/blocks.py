"""Streams: catalogue upserts, collected blocks, and tracking by overlap with the last step as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.catalogue import write_products


def upsert_stream(products: DataFrame, path: str, keys: Sequence[str], checkpoint: str):
    """Writes a stream of products to a catalogue, a batch at a time. A batch that runs again replaces its rows by the same."""
    return products.writeStream.foreachBatch(lambda df, _: None if df.isEmpty() else write_products(df, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_blocks(blocks: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows, with the batch they came in as ds, to a table. A batch that runs again overwrites its own partition."""

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("ds", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/ds={batch}")

    return blocks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EDGES = "level long, t long, t2 long, label long, next_label long, Overlap long"


def overlap_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Edges between a level's last step, which is the state, and the steps that have come."""
    columns = ["x", "y", "z", "label"]
    last, previous = (state.get if state.exists else (None, None))
    previous = pd.DataFrame(previous, columns=columns) if previous is not None else None
    out = []
    for t, now in sorted(pd.concat(batches).groupby("t"), key=lambda g: g[0]):
        now = now[columns]
        if previous is not None and t > last:
            n = previous.merge(now, on=["x", "y", "z"], suffixes=("", "_next")).groupby(["label", "label_next"]).size()
            out += [(key[0], int(last), int(t), int(a), int(b), int(k)) for (a, b), k in n.items()]
        if last is None or t > last:
            last, previous = int(t), now
    state.update((last, [list(map(float, r[:3])) + [int(r[3])] for r in previous.itertuples(index=False)] if previous is not None else None))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in EDGES.split(", ")])


def track_stream(points: DataFrame) -> DataFrame:
    """Overlap edges of a stream of points (level, t, x, y, z, label); steps of a level come in order.

    Branches are known at a stream's end; tracking.track_overlap() gives them from the whole.
    """
    state = "last long, points array<struct<x double, y double, z double, label long>>"
    return points.groupBy("level").applyInPandasWithState(_with_structs(overlap_step), EDGES, state, "append", GroupStateTimeout.NoTimeout)


def _with_structs(step: Callable) -> Callable:
    """step with its state's points as structs."""

    def run(key, batches, state):
        class Held:
            exists = state.exists

            @property
            def get(self):
                last, points = state.get
                return last, [[p["x"], p["y"], p["z"], p["label"]] for p in points] if points is not None else None

            def update(self, value):
                last, points = value
                state.update((last, [tuple([*p[:3], int(p[3])]) for p in points] if points is not None else None))

        yield from step(key, batches, Held())

    return run


def windowed_statistics(events: DataFrame, ts: str, value: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean of a stream by event-time window and key; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
