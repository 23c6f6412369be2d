"""Section state over the lines of a dump."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlab.functions.normalize import clean_markup_line, is_noise_line, java_trim
from postlab.session import stored

# ---- fixed values: section markers of an XML dump ---------------------------------------------------
SECTION_START = "<text"
SECTION_END = "</text"
# ---- end of fixed values ----------------------------------------------------------------------------
CHUNK_LINES = 4096
#: Splits that begin inside a section are broadcast up to this number, and joined beyond it.
BROADCAST_SPLITS = 200_000


def _marker(line: Column, start: str, end: str) -> Column:
    trimmed = java_trim(line)
    return F.when(trimmed.startswith(end), False).when(trimmed.startswith(start), True)


def section_lines(lines: DataFrame, keys: list[str], pos: str = "pos", line: str = "line",
                  start: str = SECTION_START, end: str = SECTION_END) -> DataFrame:
    """Lines from a start marker on (inclusive) up to an end marker (exclusive).

    Noise lines go first, so a marker on such a line is not seen. State is carried per document. A
    document of any length is handled in chunks of CHUNK_LINES positions: the state inside a chunk
    comes from a window over the chunk, the state at its start from the last marker of earlier chunks.
    The lines without noise are written once; the markers of the chunks are read from that copy.
    """
    kept = stored(
        lines.where(~is_noise_line(F.col(line)))
        .withColumn("_marker", _marker(F.col(line), start, end))
        .withColumn("_chunk", F.floor(F.col(pos) / CHUNK_LINES)), "lines")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    kept = kept.withColumn("_state", F.last("_marker", ignorenulls=True).over(inside))

    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        kept.groupBy(*keys, "_chunk")
        .agg(F.max_by("_marker", F.when(F.col("_marker").isNotNull(), F.col(pos))).alias("_last"))
        .select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    )
    return (
        kept.join(carried, [*keys, "_chunk"])
        .where(F.coalesce("_state", "_carried", F.lit(False)))
        .select(*lines.columns)
    )


def _changes(batch: pa.RecordBatch, columns: list[str], previous: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows whose columns differ from the row before, across batches; and the columns of the last row."""
    values = [pd.Series(batch.column(c).to_pylist(), dtype=object) for c in columns]
    new = np.zeros(batch.num_rows, dtype=bool)
    for series in values:
        before = series.shift()
        new |= ((series != before) & ~(series.isna() & before.isna())).to_numpy(dtype=bool)
    new[0] = tuple(series.iloc[0] for series in values) != previous
    return new, tuple(series.iloc[-1] for series in values)


def scanned_section_lines(lines: DataFrame, keys: list[str], split: str | None = None, pos: str = "pos",
                          line: str = "line", start: str = SECTION_START, end: str = SECTION_END) -> DataFrame:
    """As ``section_lines``, for lines as a scan gives them; no line is moved or stored.

    The lines of a document must lie together in a partition, in the order of ``pos``. If files are cut, ``split`` is the column
    that orders the splits of a document, and the lines of each split must lie together. Then each split is first
    reduced to its last marker, which is all it does to the state; the splits of a document are composed in order; and
    the second pass over the lines starts each split with the state carried to it. Only splits that begin inside a section are
    broadcast, and only up to BROADCAST_SPLITS of them.
    """
    segment = [*keys, *([split] if split else [])]
    kept = lines.where(~is_noise_line(F.col(line))).withColumn(
        "_marker", _marker(F.col(line), start, end).cast("int").cast("double"))
    if split:
        seen = lines.withColumn("_marker", F.when(~is_noise_line(F.col(line)), _marker(F.col(line), start, end)))
        states = seen.groupBy(*segment).agg(
            F.max_by("_marker", F.when(F.col("_marker").isNotNull(), F.col(pos))).alias("_last"))
        earlier = Window.partitionBy(*keys).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
        carried = stored(states.select(
            *[F.col(c).alias(f"_{c}") for c in segment], F.last("_last", ignorenulls=True).over(earlier).alias("_carried"),
        ).where("_carried"), "carried")
        few = carried.count() <= BROADCAST_SPLITS
        same = F.lit(True)
        for c in segment:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        if few:
            kept = kept.join(F.broadcast(carried), same, "left")
        else:  # a join by key moves lines, so they are put in order again
            kept = kept.join(carried, same, "left").repartition(*segment).sortWithinPartitions(*segment, pos)
        kept = kept.select(*lines.columns, "_marker", F.coalesce(F.col("_carried").cast("double"), F.lit(0.0)).alias("_carried"))
    else:
        kept = kept.withColumn("_carried", F.lit(0.0))
    columns = lines.columns

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, state = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, previous = _changes(batch, segment, previous)
            marker = batch.column("_marker").to_numpy(zero_copy_only=False).astype("float64")
            begun = np.where(np.isnan(marker) & new, batch.column("_carried").to_numpy(zero_copy_only=False), marker)
            states = pd.Series(begun).ffill().fillna(state).to_numpy()
            state = float(states[-1])
            yield batch.select(columns).filter(pa.array(states == 1.0))

    return kept.mapInArrow(applied, lines.schema)


def clean_lines(inside: DataFrame, line: str = "line") -> DataFrame:
    """The cleaned lines; those with nothing left go."""
    return inside.withColumn(line, clean_markup_line(F.col(line))).where(F.col(line) != "")


def clean_markup_lines(lines: DataFrame, keys: list[str], pos: str = "pos", line: str = "line",
                       start: str = SECTION_START, end: str = SECTION_END) -> DataFrame:
    """The cleaned lines inside sections; lines with nothing left go."""
    return clean_lines(section_lines(lines, keys, pos, line, start, end), line)
