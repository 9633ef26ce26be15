"""Percentiles per group from dyadic Count-sketches.

A value is encoded as an integer of ``BITS`` bits that keeps the order: sign, binary exponent and the first
``FRACTION`` bits of the fraction, so a decoded value is within 2**-(FRACTION + 1) of it. For each binary resolution
(level j keeps the code without its last j bits) there is one signed Count-sketch of ``DEPTH`` rows and ``WIDTH`` buckets;
resolutions with few cells are counted exactly. Everything is a sum: sketches of partitions, days or files are
merged by adding counters, and a value is deleted by adding its code with weight -1. A rank is inverted by walking
from the coarsest level down, going left while the rank falls into the left half.

A sketch is a table (group columns, level, row, buckets, counts): the counters of a row of a level that aren't 0, as two arrays in the order of
the buckets; at most ``TABLE_ROWS`` rows and ``MAX_COUNTERS`` counters a group, whatever the number of values, so it can be stored
per day and added up later. Every partition builds the sketches of its own values in arrays, and only these are shuffled.

Error: the rank of a reported value differs from the asked one by less than ``rank_error`` (a share of the group's
values), and the value by 2**-(FRACTION + 1). ``rank_error`` is three standard deviations of the medians passed on the way down; the noise of
a row is read from its own counters without the ``HEAVY`` largest, as few cells rarely share a bucket with those in most rows.

Defined results: null, NaN and infinite values are left out; equal values share a cell; a null group column
is a group; an empty table gives an empty sketch and no percentiles; columns that aren't named are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTION = 12
BITS = 24
HALF = 1 << (BITS - 1)
WIDTH, DEPTH = 1024, 5
#: Levels with at most 2**EXACT_BITS cells are counted exactly.
EXACT_BITS = 13
FIRST_SKETCHED = BITS - EXACT_BITS - 1
TABLE_ROWS = (FIRST_SKETCHED + 1) * DEPTH + EXACT_BITS + 1
MAX_COUNTERS = (1 << (EXACT_BITS + 1)) + (FIRST_SKETCHED + 1) * WIDTH * DEPTH
#: Counters of a row that its noise is read without, and the variance of a median of DEPTH values against that of one.
HEAVY, MEDIAN_VARIANCE = 32, 0.287
#: Codes that a task holds before it writes their counters, groups whose counters it makes at once, and counters of an output batch.
HELD_CODES, GROUPS_AT_ONCE, OUT_COUNTERS = 2_000_000, 256, 200_000
PRIME = (1 << 31) - 1


def _constants() -> list[list[tuple[int, int, int, int]]]:
    """(a, b, c, d) of each sketched level and row: bucket (a x + b) mod p mod WIDTH, sign (c x + d) mod p mod 2."""
    rng = random.Random(20)
    return [[tuple(rng.randrange(1, PRIME) for _ in range(4)) for _ in range(DEPTH)] for _ in range(FIRST_SKETCHED + 1)]


CONSTANTS = _constants()


def encode(value: Column) -> Column:
    """The order-preserving code of a double; null for null, NaN and infinite values."""
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    exponent = F.greatest(F.lit(-1022), F.least(F.lit(1023), exponent)).cast("long")
    part = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << FRACTION)).cast("long")
    part = F.greatest(F.lit(0), F.least(F.lit((1 << FRACTION) - 1), part))
    cell = (exponent + 1022) * (1 << FRACTION) + part + 1
    usable = v.isNotNull() & ~F.isnan(v) & (size < F.lit(float("inf")))
    code = F.when(size < 2.0**-1022, F.lit(HALF)).when(v > 0, F.lit(HALF) + cell).otherwise(F.lit(HALF) - cell)
    return F.when(usable, F.greatest(F.lit(0), F.least(F.lit(2 * HALF - 1), code)).cast("long"))


def decode(code: int) -> float:
    """The middle of a code's cell."""
    if code == HALF:
        return 0.0
    cell = abs(code - HALF) - 1
    value = float(2.0 ** ((cell >> FRACTION) - 1022)) * (1 + ((cell & ((1 << FRACTION) - 1)) + 0.5) / (1 << FRACTION))
    return value if code > HALF else -value


class _Partial:
    """The values of one task: codes with their weights by group, turned into counters when there are many."""

    def __init__(self, group: list[str]) -> None:
        self.group = group
        self._empty()

    def _empty(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys, self.weights = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, batch: pd.DataFrame) -> None:
        """Add a batch; equal codes of a group are added up."""
        combined = np.zeros(len(batch), np.int64)
        for c in self.group:
            codes, found = pd.factorize(batch[c].astype(object).where(batch[c].notna(), None), use_na_sentinel=False)
            combined = combined * max(1, len(found)) + codes
        _, first, inverse = np.unique(combined, return_index=True, return_inverse=True)
        rows = batch[self.group].iloc[first].astype(object)
        rows = rows.where(rows.notna(), None)
        own = np.array([self.ids.setdefault(t, len(self.ids)) for t in rows.itertuples(index=False, name=None)], np.int64)
        keys = np.concatenate([self.keys, own[inverse] << BITS | batch["__code"].to_numpy(np.int64)])
        self.keys, place = np.unique(keys, return_inverse=True)
        weights = np.concatenate([self.weights, batch["__w"].to_numpy(np.int64)])
        self.weights = np.zeros(len(self.keys), np.int64)
        np.add.at(self.weights, place, weights)

    def counters(self) -> Iterator[pd.DataFrame]:
        """The sketches of what was added, some groups at a time; then it is empty."""
        names = list(self.ids)
        owner = self.keys >> BITS
        for low in range(0, len(names), GROUPS_AT_ONCE):
            a, b = np.searchsorted(owner, (low, low + GROUPS_AT_ONCE))
            if a < b:
                yield self._sketches(names[low : low + GROUPS_AT_ONCE], owner[a:b] - low, self.keys[a:b] & ((1 << BITS) - 1), self.weights[a:b])
        self._empty()

    def _sketches(self, names: list[tuple], owner: np.ndarray, code: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
        out = []
        for level in range(BITS + 1):
            x = code >> level
            if level > FIRST_SKETCHED:
                tables = [(0, 1 << (BITS - level), x, weight)]
            else:
                tables = [(row, WIDTH, (x * a + b) % PRIME % WIDTH, weight * (1 - 2 * ((x * c + d) % PRIME % 2))) for row, (a, b, c, d) in enumerate(CONSTANTS[level])]
            for row, width, bucket, n in tables:
                cell, sums = _summed(owner * width + bucket, n, len(names) * width)
                ends = np.searchsorted(cell, np.arange(len(names) + 1) * width)
                out += [(*names[g], level, row, (cell[i:j] - g * width).astype(np.int32), sums[i:j]) for g, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
        return pd.DataFrame(out, columns=[*self.group, "level", "row", "buckets", "counts"])


def _summed(key: np.ndarray, n: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys whose ``n`` don't add up to 0, in order, and their sums."""
    if len(key) * 8 < cells:
        found, place = np.unique(key, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
    else:
        found, place, sums = np.arange(cells), key, np.zeros(cells, np.int64)
    np.add.at(sums, place, n)
    kept = np.flatnonzero(sums)
    return found[kept], sums[kept]


def _fields(rows: DataFrame, group: list[str]) -> T.StructType:
    added = [T.StructField("level", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    return T.StructType([*rows.select(*group).schema.fields, *added])


def sketch(rows: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """The sketch of ``value`` per group; ``weight`` (default 1) may be negative to delete values."""
    coded = rows.select(*group, encode(F.col(value)).alias("__code"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w"))
    coded = coded.filter(F.col("__code").isNotNull() & F.col("__w").isNotNull())

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partial = _Partial(group)
        for batch in batches:
            if len(batch):
                partial.add(batch)
            if len(partial.keys) >= HELD_CODES:
                yield from partial.counters()
        yield from partial.counters()

    return merge(coded.mapInPandas(build, _fields(rows, group)), group)


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches added up to the given (possibly coarser) groups.

    Rows of one table meet in order in one task, which adds them one by one: it holds one table, however many are added.
    """
    key = [*group, "level", "row"]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total, out, held = None, None, [], 0

        def closed() -> None:
            nonlocal held
            kept = np.flatnonzero(total)
            if len(kept):
                out.append((*last, kept.astype(np.int32), total[kept]))
                held += len(kept)

        for batch in batches:
            rows = batch[key].astype(object)
            names = rows.where(rows.notna(), None).itertuples(index=False, name=None)
            for name, buckets, counts in zip(names, batch["buckets"], batch["counts"], strict=True):
                if name != last:
                    if last is not None:
                        closed()
                    level = int(name[-2])
                    last, total = name, np.zeros(WIDTH if level <= FIRST_SKETCHED else 1 << (BITS - level), np.int64)
                total[np.asarray(buckets)] += np.asarray(counts)
                if held >= OUT_COUNTERS:
                    yield pd.DataFrame(out, columns=[*key, "buckets", "counts"])
                    out, held = [], 0
        if last is not None:
            closed()
        yield pd.DataFrame(out, columns=[*key, "buckets", "counts"])

    rows = sketches.select(*key, "buckets", "counts").repartition(*key).sortWithinPartitions(*key)
    return rows.mapInPandas(add, _fields(sketches, group))


def counters(sketches: DataFrame, group: list[str]) -> DataFrame:
    """(group, level, row, bucket, n): a row for each counter."""
    pairs = F.explode(F.arrays_zip("buckets", "counts")).alias("c")
    return sketches.select(*group, "level", "row", pairs).select(*group, "level", "row", F.col("c.buckets").alias("bucket"), F.col("c.counts").alias("n"))


class Levels:
    """The counters of one group, for estimates."""

    def __init__(self, tables: Iterable[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        self.exact: dict[int, np.ndarray] = {}
        self.tables = np.zeros((FIRST_SKETCHED + 1, DEPTH, WIDTH))
        for level, row, buckets, counts in tables:
            if level <= FIRST_SKETCHED:
                self.tables[level, row, np.asarray(buckets)] = counts
            else:
                table = self.exact.setdefault(int(level), np.zeros(1 << (BITS - int(level)), np.int64))
                table[np.asarray(buckets)] = counts
        self.total = int(self.exact[BITS][0]) if BITS in self.exact else 0

    def estimate(self, level: int, x: int) -> float:
        """Estimated number of values in cell x of a level."""
        if level > FIRST_SKETCHED:
            return float(self.exact[level][x]) if level in self.exact else 0.0
        found = [(1 - 2 * ((c * x + d) % PRIME % 2)) * self.tables[level, row, (a * x + b) % PRIME % WIDTH] for row, (a, b, c, d) in enumerate(CONSTANTS[level])]
        return float(np.median(found))

    def rank_error(self) -> float:
        """Three standard deviations of a rank, as a share of the values."""
        squares = np.sort(self.tables**2, axis=2)[:, :, :-HEAVY].sum(axis=2)
        noise = np.median(squares, axis=1).sum() / (WIDTH - HEAVY) * MEDIAN_VARIANCE
        return 3 * float(np.sqrt(noise)) / self.total if self.total else 0.0

    def value(self, q: float) -> float:
        """The value at rank ceil(q n), at least the first."""
        rank, x, here = max(1.0, np.ceil(q * self.total)), 0, float(self.total)
        for level in range(BITS - 1, -1, -1):
            x *= 2
            left = self.estimate(level, x)
            if level <= FIRST_SKETCHED:  # what the right half leaves is a second estimate of the left one
                left = min(max(0.0, (left + here - self.estimate(level, x + 1)) / 2), here)
            if rank > left:
                rank, here = rank - left, here - left
                x += 1
            else:
                here = left
        return decode(x)


def percentiles(sketches: DataFrame, group: list[str], qs: list[float]) -> DataFrame:
    """(group, q, n, value, rank_error) of each group of a sketch; a group's counters are bounded by MAX_COUNTERS."""
    fields = sketches.select(*group).schema.fields
    wanted = list(qs)

    def invert(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        levels = Levels(pdf[["level", "row", "buckets", "counts"]].itertuples(index=False, name=None))
        rows = [(*key, q, levels.total, levels.value(q), levels.rank_error()) for q in wanted] if levels.total > 0 else []
        return pd.DataFrame(rows, columns=[*group, "q", "n", "value", "rank_error"]).astype({"n": "int64", "q": float, "value": float, "rank_error": float})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", q double, n long, value double, rank_error double"
    return sketches.groupBy(*group).applyInPandas(invert, schema)
