"""Pruned joins of vectors: two distributed sides meet cell by cell, and cells that the
triangle inequality rules out are never formed.

Every row goes to the list of its nearest pivot (``pivots``: rows of least id hash, at most
``MAX_LISTS``). A list is a ball: its pivot, its radius and its rows' lengths. For two lists
the distance of any two of their rows is at least the pivots' distance less both radii; a
pair of lists is kept only if that bound leaves an answer possible. What the driver holds is a row
a list and the kept pairs of lists, both bounded by ``MAX_LISTS``. A list of many rows is cut
into blocks by a hash of the id, so a hot list is many cells, and a cell is bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.operators.knn import matrix_of, unit_rows
from docsift.operators.quantiser import CentroidTree, by_differences
from docsift.session import ship_package

MAX_LISTS = 1024
CELL_BYTES = 16 << 20
SLACK = 1e-6


def pivots(rows: DataFrame, name: str, count: int) -> np.ndarray:
    """Embeddings of the ``count`` rows of least hash of ``name``, without repeats."""
    some = rows.orderBy(F.xxhash64(name), name).limit(count).select("embedding").collect()
    return np.unique(np.asarray([r["embedding"] for r in some], dtype=np.float64), axis=0) if some else np.zeros((0, 0))


def assigned(rows: DataFrame, centres: np.ndarray, unit: bool = False) -> DataFrame:
    """``rows`` with ``_list`` (nearest pivot), ``_far`` (distance to it) and ``_length`` (of the
    vector, 0 for a zero one); with ``unit`` vectors are scaled to length one before."""
    ship_package(rows.sparkSession)
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("_list", T.IntegerType()), T.StructField("_far", T.DoubleType()), T.StructField("_length", T.DoubleType())]
    )

    def run(batches):
        tree = CentroidTree(centres)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column("embedding"), centres.shape[1])
            length = np.sqrt(np.einsum("ij,ij->i", x, x))
            x = unit_rows(x) if unit else x
            own = tree.nearest(x)
            far = np.sqrt(by_differences(x, centres, own))[:, 0]
            columns = [*b.columns, pa.array(own[:, 0].astype(np.int32)), pa.array(far), pa.array(length)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Balls:
    """Lists of one side: rows, radius, least and largest vector length, and what ``extra`` is the
    maximum of; arrays by list number."""

    rows: np.ndarray
    radius: np.ndarray
    short: np.ndarray
    long: np.ndarray
    extra: np.ndarray

    @staticmethod
    def of(rows: DataFrame, count: int, extra: str | None = None) -> Balls:
        out = Balls(np.zeros(count, dtype=np.int64), *(np.zeros(count) for _ in range(4)))
        found = rows.groupBy("_list").agg(
            F.count("*"), F.max("_far"), F.min("_length"), F.max("_length"), F.max(extra) if extra else F.lit(0.0)
        )
        for r in found.collect():  # a row a list
            i = r[0]
            out.rows[i], out.radius[i], out.short[i], out.long[i], out.extra[i] = r[1:]
        return out

    def blocks(self, most: int) -> np.ndarray:
        return np.maximum(1, -(-self.rows // most)).astype(np.int64)


def gaps(centres: np.ndarray, left: Balls, right: Balls) -> np.ndarray:
    """Least possible distance of a row of list i (left) to one of list j (right)."""
    n = len(centres)
    d = np.empty((n, n))
    for i in range(n):
        d[i] = np.sqrt(((centres - centres[i]) ** 2).sum(axis=1))
    return np.maximum(0.0, d - left.radius[:, None] - right.radius[None, :] - SLACK * (1 + d))


def rows_per_cell(dim: int, cell_bytes: int = CELL_BYTES) -> int:
    return max(1, cell_bytes // (8 * max(1, dim)))


def join_cells(left: DataFrame, right: DataFrame, keep: np.ndarray, lb: np.ndarray, rb: np.ndarray, columns: tuple[list[str], list[str]],
               names: tuple[str, str], cell: Callable[[pa.Table, pa.Table], pa.Table], schema, same: bool = False) -> DataFrame:
    """``cell(left rows, right rows)`` for every block pair of the kept list pairs. ``lb`` and ``rb``
    are the blocks of each list, ``names`` the id columns. With ``same`` both sides are one table
    and a list meets itself in each unordered pair of blocks once. Both tables get ``_ci, _x, _cj, _y``."""
    spark = left.sparkSession
    i, j = np.nonzero(keep)
    pairs = spark.createDataFrame(
        pa.table({"_ci": i.astype(np.int32), "_cj": j.astype(np.int32), "_lb": lb[i].astype(np.int32), "_rb": rb[j].astype(np.int32)})
    )
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    key = ["_ci", "_x", "_cj", "_y"]
    a = left.withColumnRenamed("_list", "_ci").join(pairs, "_ci").withColumn("_x", block(names[0], "_lb")).withColumn("_y", F.explode(upto("_rb")))
    b = right.withColumnRenamed("_list", "_cj").join(pairs, "_cj").withColumn("_y", block(names[1], "_rb")).withColumn("_x", F.explode(upto("_lb")))
    if same:
        once = (F.col("_ci") != F.col("_cj")) | (F.col("_x") <= F.col("_y"))
        a, b = a.filter(once), b.filter(once)
    fresh = [F.col(c).alias(c) for c in columns[1]]  # else a table's columns are ambiguous when it meets itself
    return (
        a.select(*key, *columns[0]).groupBy(*key)
        .cogroup(b.select(*key, *fresh).groupBy(*key)).applyInArrow(cell, schema)
    )
