"""Running sums and positions in an order, without a task or the driver holding a group.

Rows are written (a range sort samples its input, which would otherwise be computed twice), range-sorted by group and
order and written again (so both passes see the same partitions); each partition sums its own rows per group while it writes; the sums per (partition, group) get their prefix sums, which
are the running totals at which each partition's share of a group begins. A hot group is spread over as many
partitions as it needs, and a row's running total is its partition's start plus the sum inside.

Defined results: a null group is a group; a null value counts as 0; ties in the order fall to the
remaining order columns and then to chance, so give a unique last one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import broadcast_if_small, written


def _stored(df: DataFrame) -> bool:
    """Do the rows come straight from files, so that reading them twice is cheap?"""
    plan = df._jdf.queryExecution().optimizedPlan()
    return not any(word in plan.toString() for word in ("Join", "Aggregate", "Window", "InPandas", "InArrow", "EvalPython", "Generate"))


def running(df: DataFrame, group: str | None, order: list[Column], values: list[str], name: str = "running") -> DataFrame:
    """``df`` with ``before_<value>`` for each of the BIGINT ``values``: its sum over all earlier rows of the group."""
    keys = [F.col(group)] if group else []
    df = df if _stored(df) else written(df, f"{name}-rows")
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    added = [T.StructField("__part", T.IntegerType()), *(T.StructField(f"__in_{v}", T.LongType()) for v in values)]
    schema = T.StructType([*ordered.schema.fields, *added])

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {v: (None, 0) for v in values}
        for batch in batches:
            keys = batch[group].astype(object).where(batch[group].notna(), None) if group else pd.Series("", index=batch.index)
            codes, uniques = pd.factorize(keys, use_na_sentinel=False)
            for v in values:
                own = batch[v].fillna(0).astype("int64")
                by = own.groupby(codes, sort=False)
                sums = by.cumsum() - own
                last_key, carried = totals[v]
                if len(batch):  # groups are contiguous, so only the first group of a batch can go on
                    first = keys.iloc[0]
                    same = first == last_key or first != first and last_key != last_key or first is None and last_key is None
                    if same and carried:
                        sums = sums.where(codes != codes[0], sums + carried)
                    end = int(sums.iloc[-1] + own.iloc[-1])
                    totals[v] = keys.iloc[-1], end
                batch[f"__in_{v}"] = sums
            yield batch

    rows = written(ordered.withColumn("__part", F.spark_partition_id()).mapInPandas(inside, schema), name)
    by = ["__part", *([group] if group else [])]
    parts = rows.groupBy(*by).agg(*(F.sum(v).alias(f"__of_{v}") for v in values))
    window = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("__part").alias("__p"),
        *([F.col(group).alias("__g")] if group else []),
        *(F.coalesce(F.sum(f"__of_{v}").over(window), F.lit(0)).alias(f"__start_{v}") for v in values),
    )
    # a group that lies in one partition starts at 0: only the others need a start
    starts = starts.filter(" OR ".join(f"__start_{v} <> 0" for v in values))
    starts = broadcast_if_small(written(starts, f"{name}-starts"))
    same = F.col("__part") == F.col("__p")
    rows = rows.join(starts, same & F.col(group).eqNullSafe(F.col("__g")) if group else same, "left")
    for v in values:
        rows = rows.withColumn(f"before_{v}", F.coalesce(f"__start_{v}", F.lit(0)) + F.col(f"__in_{v}"))
    return rows.drop("__part", "__p", "__g", *(f"__in_{v}" for v in values), *(f"__start_{v}" for v in values))


def positions(df: DataFrame, group: str | None, order: list[Column], name: str = "positions") -> DataFrame:
    """``df`` with ``position``: the number of earlier rows of the group."""
    return running(df.withColumn("one", F.lit(1).cast("long")), group, order, ["one"], name).withColumnRenamed("before_one", "position").drop("one")
