"""Training batches of sliding frames without a copy of the history in every row.

A series is cut into chunks of consecutive grid rows, each with the rows before
and behind that its frames reach into: one row per chunk, with an array per
column. That is all that moves, little more than the input. Frames are then
views into a chunk's arrays, made where the chunk lies, and only the batch in
hand is laid out, for a trainer that takes one batch after the other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.functions.timecols import grid_pos, pos_start
from gridcast.functions.values import missing_to_null
from gridcast.operators.grid import CHUNK, with_halo

#: A chunk is so many times as long as a frame reaches, so the rows that two chunks share are about an eighth.
REACHES = 8


def chunk_size(history: int, target: int, chunk: int = CHUNK) -> int:
    return max(chunk, REACHES * (history + target))


def frame_chunks(
    df: DataFrame,
    columns: Sequence[str],
    history: int,
    target: int,
    step: timedelta,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per chunk: the keys, `chunk`, `positions` of its rows on the grid, and an array of doubles per column.

    Times are on the grid and unique per series.
    """
    narrow = df.select(*keys, grid_pos(ts, step).alias("_pos"), *[missing_to_null(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    placed = with_halo(narrow, history, target, chunk_size(history, target, chunk))
    row = F.struct("_pos", *[f"_v{i}" for i in range(len(columns))])
    packed = placed.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    arrays = [F.col("_rows")[f"_v{i}"].alias(c) for i, c in enumerate(columns)]
    return packed.select(*keys, F.col("_chunk").alias("chunk"), F.col("_rows._pos").alias("positions"), *arrays)


def frame_batches(
    chunks: DataFrame,
    features: Sequence[str],
    label: str,
    history: int,
    target: int,
    step: timedelta,
    batch: int,
    stride: int = 1,
    keys: Sequence[str] = ("series_id",),
    chunk: int = CHUNK,
) -> DataFrame:
    """Batches of up to `batch` frames of a chunk: the keys, `anchors` (times), `x` and `y`.

    The frames are those of :func:`gridcast.operators.frames.sliding_frames`.
    `x` holds the features of every `stride`-th row before the anchor, frame by
    frame, step by step, feature by feature; `y` the `target` labels from the
    anchor on. Missing values are NaN.
    """
    size = chunk_size(history, target, chunk)
    kept = [f for f in chunks.schema.fields if f.name in keys]
    schema = T.StructType([*kept, *T.StructType.fromDDL("_at array<long>, x array<double>, y array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                own = int(rows.column("chunk")[i].as_py())
                pos = rows.column("positions")[i].values.to_numpy()
                if len(pos) <= history + target:
                    continue
                values = {c: rows.column(c)[i].values.to_numpy(zero_copy_only=False) for c in {*features, label}}
                past = np.lib.stride_tricks.sliding_window_view(np.stack([values[f] for f in features], axis=1), history, axis=0)
                ahead = np.lib.stride_tricks.sliding_window_view(values[label], target)
                at = np.arange(history, len(pos) - target)
                whole = (pos[at] - pos[at - history] == history) & (pos[at + target] - pos[at] == target) & (pos[at] // size == own)
                at = at[whole]
                for first in range(0, len(at), batch):
                    some = at[first : first + batch]
                    x = past[some - history][:, :, ::stride].transpose(0, 2, 1)  # frame, step, feature
                    columns = [rows.column(k).slice(i, 1) for k in (f.name for f in kept)]
                    numbers = [pa.array([a.ravel()]) for a in (pos[some], x, ahead[some])]
                    yield pa.RecordBatch.from_arrays([*columns, *numbers], schema.names)

    made = chunks.mapInArrow(run, schema)
    anchors = F.transform("_at", lambda p: pos_start(p, step)).alias("anchors")
    return made.select(*keys, anchors, "x", "y")
