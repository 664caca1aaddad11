"""Deduplication, lookups and merging with an explicit row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import pinned


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``; null keys form a group of their own."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def priority_dedupe(cases: DataFrame, order: str = "ord", keys: tuple[str, ...] = ("docket_number",)) -> DataFrame:
    """One appellate case per docket (``keys``), majority opinions first; other cases stay."""
    majority = F.when(F.lower("opinion_type") == "majority", 0).otherwise(1)
    appellate = first_per(cases.where("is_appellate = 1"), list(keys), [majority, F.col(order)])
    return appellate.unionByName(cases.where("is_appellate <> 1 or is_appellate is null"))


def overwrite_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``second``, and those of ``first`` whose key it does not have; null keys of ``first`` stay."""
    return second.unionByName(first.join(second.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(second.columns))


def any_with_prefix(df: DataFrame, column: str, *prefixes: str) -> DataFrame:
    """One row with a flag for each prefix: whether any id begins with it (false for an empty table)."""
    return df.agg(*(F.coalesce(F.bool_or(F.startswith(F.col(column).cast("string"), F.lit(p))), F.lit(False)).alias(p) for p in prefixes))


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df``, and an observation that has its number of rows once it was computed, without a job of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias(name)), seen


def lookup(df: DataFrame, other: DataFrame, on: str, value: str, order: list[Column | str]) -> DataFrame:
    """``df`` with ``value`` of the first row of ``other`` that has the key and a value."""
    return df.join(first_per(other.where(F.col(value).isNotNull() & F.col(on).isNotNull()), [on], order).select(on, value), on, "left")


def backfill_merge(main: DataFrame, other: DataFrame, key: str, fill: list[str], order: str = "ord") -> DataFrame:
    """Rows of ``main`` with nulls of ``fill`` taken from ``other`` by key, then ``other``'s rows whose key is new.

    Keys are trimmed; null keys match nothing.  Each filled column takes its own first non-null
    row of ``other`` by ``order``, and of rows equal in that the smallest value; all of them come from
    one grouped pass over it.
    """
    keyed = lambda d: d.withColumn("_key", F.trim(F.col(key).cast("string")))
    a, b = keyed(main), keyed(other)
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(f"_{c}") for c in fill]
    filled = a.join(b.where("_key is not null").groupBy("_key").agg(*first), "_key", "left")
    filled = filled.withColumns({c: F.coalesce(c, f"_{c}") for c in fill}).select(*main.columns)
    fresh = b.join(a.select("_key").where("_key is not null").distinct(), "_key", "left_anti")
    shared = [c for c in main.columns if c in other.columns]
    return filled.unionByName(fresh.select(*shared), allowMissingColumns=True)


def row_numbers(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Consecutive numbers from 0 in ``order`` without a single-task sort.

    Rows are range-partitioned and sorted; each partition's number of rows, added up, is where
    the next one starts.  The partition table has one row per partition.  Rows and their partitions
    are written down once, since a second reading may draw other borders.
    """
    ranged = pinned(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part").orderBy(*order)
    numbered = ranged.withColumn("_local", F.row_number().over(local) - 1)
    sizes = numbered.groupBy("_part").count()
    starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))
    return numbered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error that names the missing columns."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of ``columns`` that exist."""
    return df.select([c for c in columns if c in df.columns])


def pack_by_bytes(sized: DataFrame, cap: int, order: str = "ord") -> DataFrame:
    """``part`` of each row ``(ord, n_bytes)``: rows in order, a part closes before it would exceed ``cap``.

    Greedy packing is a fold over the order, so the sizes (two numbers a row, not the payloads)
    pass through one sorted stream with constant state.
    """

    def fold(batches):
        import pyarrow as pa

        part, held = 1, 0
        for batch in batches:
            parts = []
            for n in batch.column("n_bytes").to_pylist():
                if held and held + n > cap:
                    part, held = part + 1, 0
                held += n
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(order), batch.column("n_bytes"), pa.array(parts, pa.int64())], [order, "n_bytes", "part"])

    rows = sized.select(F.col(order).cast("long").alias(order), F.col("n_bytes").cast("long").alias("n_bytes"))
    return rows.repartition(1).sortWithinPartitions(order).mapInArrow(fold, f"{order} long, n_bytes long, part long")
