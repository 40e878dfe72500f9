"""What the vector operators share: which rows take part, and pairs of bounded blocks of rows and queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, quoted

#: Values (rows times length) of a block, so that a task holds a few MB of vectors whatever their length.
BLOCK_VALUES = 1 << 19


def usable(rows: DataFrame, vector: str, nonzero: bool = False) -> DataFrame:
    """(row, v): each row as one struct and its vector as doubles, without rows whose vector is null, empty, holds
    null or non-finite entries, is all zeros (if asked) or has another length than most (ties: the shorter)."""
    v = F.col("row")[vector].cast("array<double>")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.select(F.struct(*[F.col(quoted(c)) for c in rows.columns]).alias("row")).select("row", v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", sound) & (F.size("v") > 0))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.where(F.size("v") == length(rows))


def length(rows: DataFrame) -> int:
    """The most frequent length of v; 0 for an empty table."""
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return most[0]["size"] if most else 0


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def block_rows(size: int) -> int:
    return max(1, BLOCK_VALUES // max(1, size))


def _dealt(id: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(id)), blocks).cast("int")


def in_blocks(rows: DataFrame, row_blocks: tuple[Column, Column], queries: DataFrame, query_blocks: tuple[Column, Column], keys: list[str]):
    """Groups of one block of rows(id, ...) and one of queries(query, ...) that agree on the keys: every such pair once.

    Each side says, in its own columns, how many blocks rows and queries have."""
    queries = queries.toDF(*queries.columns)  # both may stem from one table
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.withColumn("row_block", _dealt("id", row_blocks[0])).withColumn("query_block", every(row_blocks[1]))
    right = queries.withColumn("query_block", _dealt("query", query_blocks[1])).withColumn("row_block", every(query_blocks[0]))
    by = [*keys, "row_block", "query_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by))


def keyed_blocks(rows: DataFrame, queries: DataFrame, keys: list[str], per_block: int, queries_per_block: int):
    """in_blocks() where each key has as many blocks as its own rows and queries need.

    Counts are written first, so Spark knows their size and joins them by broadcast where they are small, else by a
    sort-merge join whose hot keys it can split."""
    queries = queries.toDF(*queries.columns)
    blocks = lambda per: F.ceil(F.count(F.lit(1)) / per).cast("int")
    sizes = materialize(rows.groupBy(*keys).agg(blocks(per_block).alias("n_rows")).join(queries.groupBy(*keys).agg(blocks(queries_per_block).alias("n_queries")), keys))
    again = sizes.toDF(*keys, "n_query_rows", "n_query_queries")  # columns of its own, as both sides meet again
    return in_blocks(rows.join(sizes, keys), (F.col("n_rows"), F.col("n_queries")), queries.join(again, keys), (F.col("n_query_rows"), F.col("n_query_queries")), keys)


def one_per_id(rows: DataFrame, *rest: str) -> DataFrame:
    """Of rows that share an id, the one that is least by the other columns; rows without an id go."""
    least = F.min(F.struct(*rest)).alias("least")
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(least).select("id", *[F.col(f"least.{c}").alias(c) for c in rest])
