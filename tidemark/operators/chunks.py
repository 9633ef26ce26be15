"""Per-key results by exact offset chunking, for keys of which a few hold most rows.

1. Values with more rows than a chunk are counted; there are fewer of them than chunks, so they fit anywhere. Each input partition
   numbers its rows of these values and writes key, measures and number to the shared folder (``numbered``). From then on
   the partitions are fixed data, whatever executor is lost.
2. The rows of each (partition, key) are counted, and prefix sums over the partitions give the
   offset at which each partition's rows of a key begin (``offsets``). All rows of the other keys are chunk 0.
3. Offset plus number is the row's exact position within its key; position divided by the chunk
   size is its chunk. All chunks of a key but the last have equal size, so no task gets more than
   one chunk of a hot key (``chunked``).
4. Chunks are reduced to states, and the states of a key are merged in the order of the chunks (``totals``, ``longest_gaps``).

Defined results: a null key is a key of its own (null); null measures count as absent; an empty table gives an
empty result; repeated rows are rows; columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import broadcast_if_small, written

#: Most rows of a chunk, unless the caller says otherwise: small enough for one task, whatever the key.
CHUNK_ROWS = 1_000_000
#: A table is cut into at least so many chunks' worth of rows, and so many for each task slot: a key with a tenth of the rows is split.
LEAST_CHUNKS, CHUNKS_A_SLOT = 20, 2


@dataclass(frozen=True)
class Numbered:
    """Written rows with ``__part``, ``__row`` (number in the partition) and, per key column k, ``__no_k``: the number among the
    partition's rows of that value, null for values with at most ``chunk_rows`` rows."""

    rows: DataFrame
    chunk_rows: int


def hot_values(df: DataFrame, keys: list[str], chunk_rows: int) -> dict[str, list]:
    """The values of each key column with more than ``chunk_rows`` rows: per key fewer than rows / chunk_rows. One pass for all keys."""
    columns = [F.col(k) for k in keys]
    counts = df.select(*keys).groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("__n"), F.grouping_id().alias("__set"))
    out: dict[str, list] = {k: [] for k in keys}
    for row in counts.filter(F.col("__n") > chunk_rows).collect():
        at = next(i for i in range(len(keys)) if not row["__set"] >> (len(keys) - 1 - i) & 1)
        out[keys[at]].append(row[at])
    return out


def numbered(df: DataFrame, keys: list[str], chunk_rows: int | None = None, name: str = "chunks", counted: DataFrame | None = None) -> Numbered:
    """Number and write the rows of ``df``; without ``chunk_rows`` it is ``chunk_size``. The order of rows in ``df`` is their order in a key.

    Give the same rows in any order as ``counted`` if ``df`` sorts them: only that is counted beforehand.
    """
    counted = df if counted is None else counted
    chunk_rows = chunk_size(counted) if chunk_rows is None else chunk_rows
    hot = hot_values(counted, keys, chunk_rows)
    added = [T.StructField("__part", T.IntegerType()), T.StructField("__row", T.LongType()), *(T.StructField(f"__no_{k}", T.LongType()) for k in keys)]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {k: dict.fromkeys(hot[k], 0) for k in keys}
        done = 0
        for batch in batches:
            batch["__row"] = np.arange(done, done + len(batch))
            done += len(batch)
            for k in keys:
                values = batch[k].astype(object).where(batch[k].notna(), None)
                codes, uniques = pd.factorize(values, use_na_sentinel=False)
                uniques = [None if u is None or u != u else u for u in uniques]
                start = np.fromiter((seen[k].get(u, -1) for u in uniques), dtype=np.int64, count=len(uniques))
                inside = pd.Series(codes).groupby(codes, sort=False).cumcount().to_numpy() if len(codes) else np.empty(0, np.int64)
                own = pd.Series(start[codes] + inside, index=batch.index, dtype="Int64")
                batch[f"__no_{k}"] = own.mask(start[codes] < 0)
                for u, n in zip(uniques, np.bincount(codes, minlength=len(uniques)), strict=True):
                    if u in seen[k]:
                        seen[k][u] += int(n)
            yield batch

    with_part = df.withColumn("__part", F.spark_partition_id())
    return Numbered(written(with_part.mapInPandas(number, T.StructType([*df.schema.fields, *added])), name), chunk_rows)


def chunk_size(rows: DataFrame) -> int:
    """Rows of a chunk for this table: its rows divided by a multiple of the task slots, at most CHUNK_ROWS."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(CHUNK_ROWS, rows.count() // max(LEAST_CHUNKS, CHUNKS_A_SLOT * slots)))


def offsets(numbered: Numbered, key: str) -> DataFrame:
    """(__part, key, __offset) of the numbered keys: the rows in earlier partitions."""
    counts = numbered.rows.filter(F.col(f"__no_{key}").isNotNull()).groupBy("__part", key).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("__part", key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))


def chunked(numbered: Numbered, key: str) -> DataFrame:
    """The numbered rows with ``__position`` (within the key, from 0; null for keys that fit into one chunk) and ``__chunk``.

    Within a chunk, ``__part`` and ``__row`` give the order of the rows.
    """
    rows, number = numbered.rows, F.col(f"__no_{key}")
    place = written(offsets(numbered, key), "offsets").select(F.col("__part").alias("__p"), F.col(key).alias("__k"), "__offset")
    joined = rows.join(
        broadcast_if_small(place),
        number.isNotNull() & (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")),
        "left",
    )
    position = F.col("__offset") + number
    chunk = F.coalesce(F.floor(position / F.lit(numbered.chunk_rows)), F.lit(0))
    return joined.withColumn("__position", position).withColumn("__chunk", chunk.cast("long")).drop("__p", "__k", "__offset")


def totals(numbered: Numbered, key: str, states: dict[str, Column], merges: dict[str, Column]) -> DataFrame:
    """(key, merged columns): ``states`` reduces each chunk, ``merges`` combines the states of a key.

    ``merges`` sees one row per chunk with the state columns and ``__chunk``; order-dependent merges
    use it, e.g. ``F.max_by('last', '__chunk')``.
    """
    chunk_states = chunked(numbered, key).groupBy(key, "__chunk").agg(*(c.alias(n) for n, c in states.items()))
    return chunk_states.groupBy(key).agg(*(c.alias(n) for n, c in merges.items()))


def longest_gaps(numbered: Numbered, key: str, value: str) -> DataFrame:
    """(key, rows, gap): the largest step of ``value`` (BIGINT) from a row to the next of the key, in the order of the rows.

    A merge that depends on the order: a chunk's state is its first and last value and its largest step, and between two
    neighbouring chunks lies the step from the last of one to the first of the other. A key with one row has a null gap.
    """
    place = F.struct("__part", "__row")
    inside = Window.partitionBy(key, "__chunk").orderBy("__part", "__row")
    steps = chunked(numbered, key).withColumn("__step", F.col(value) - F.lag(value).over(inside))
    states = steps.groupBy(key, "__chunk").agg(
        F.count(F.lit(1)).alias("__n"), F.min_by(value, place).alias("__first"), F.max_by(value, place).alias("__last"), F.max("__step").alias("__most")
    )
    border = F.col("__first") - F.lag("__last").over(Window.partitionBy(key).orderBy("__chunk"))
    return states.withColumn("__border", border).groupBy(key).agg(F.sum("__n").alias("rows"), F.max(F.greatest("__most", "__border")).alias("gap"))
