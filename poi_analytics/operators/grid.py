"""Rows and vectors packed into arrays, a block a partition, for work that meets them block by block.

A packed block is written once into the shared checkpoint folder and is one element of its partition.  Blocks of
two tables meet by ``RDD.cartesian``, whose tasks read the written blocks themselves: nothing is shuffled and no copy of a
block is written, however many others it meets.  Only blocks are paired that way, never rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.serializers import CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint_dir

#: Rows of a training set or frame that meet their users and items in one task, and the fewest worth a task.
CELL_ROWS, LEAST_CELL_ROWS = 2_000_000, 16_384

Arrays = dict[str, np.ndarray]


def arrays(table: pa.Table) -> Arrays:
    """The columns as arrays, a column of equally long lists as a matrix."""
    out = {}
    for name, column in zip(table.column_names, table.columns):
        column = column.combine_chunks()
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), flat.dtype)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def packed(df: DataFrame, block: Column, blocks: int, sort: list[str]) -> RDD:
    """Partition b holds one element: the columns of the rows of block b (``block`` gives 0 .. blocks - 1), sorted."""
    schema = to_arrow_schema(df.schema)

    def pack(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found).sort_by([(c, "ascending") for c in sort])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(arrays(table), 5)], pa.binary())], ["packed"])

    def one(rows):
        found = [pickle.loads(r["packed"]) for r in rows]
        return found or [arrays(schema.empty_table())]

    return df.repartitionById(blocks, block.cast("int")).mapInArrow(pack, "packed binary").rdd.mapPartitions(one)


def written(rdd: RDD) -> RDD:
    """``rdd``, of one element a partition, in the checkpoint folder (which ``checkpoint_dir`` has set)."""
    rdd = rdd._reserialize(CPickleSerializer())  # no batches, so that partitions can be zipped as they are
    rdd.checkpoint()
    rdd.count()
    return rdd


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(blocks)).cast("int")


def places(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand among the ascending ``ids``, and which are there at all."""
    if not len(ids):
        return np.zeros(len(wanted), np.int32), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1).astype(np.int32)
    return at, ids[at] == wanted


def grid_side(rows: int, parallelism: int) -> int:
    """Blocks a side: cells of about CELL_ROWS rows, or smaller ones down to LEAST_CELL_ROWS for two a core."""
    whole = -(-rows // CELL_ROWS)
    spread = min(2 * parallelism, rows // LEAST_CELL_ROWS)
    return max(1, int(np.ceil(np.sqrt(max(whole, spread)))))


@dataclass
class Grid:
    """Rows in the cells of (user block, item block), each beside what its users and its items have.

    A cell's element holds ``u`` and ``i``, the places of a row's user and item in the two blocks; rows without either
    are left out.  A row is shipped once, when it is dealt to its cell.
    """

    cells: RDD
    users: RDD
    items: RDD

    @classmethod
    def of(cls, rows: DataFrame, users: DataFrame, items: DataFrame, side: int) -> Grid:
        """``rows`` has user_idx and item_idx, ``users`` and ``items`` an ``id`` each."""
        checkpoint_dir(rows.sparkSession)
        sides = [written(packed(t.withColumn("id", F.col("id").cast("long")), block_of(F.col("id"), side), side, ["id"]))
                 for t in (users, items)]
        cell = block_of(F.col("user_idx"), side) * side + block_of(F.col("item_idx"), side)
        dealt = packed(rows.withColumns({c: F.col(c).cast("long") for c in ("user_idx", "item_idx")}),
                       cell, side * side, ["user_idx", "item_idx"])._reserialize(CPickleSerializer())

        def resolve(pair):
            row, (user, item) = pair
            (u, has_u), (i, has_i) = places(user["id"], row.pop("user_idx")), places(item["id"], row.pop("item_idx"))
            keep = np.flatnonzero(has_u & has_i)
            return {k: v[keep] for k, v in ({"u": u, "i": i} | row).items()}

        return cls(written(dealt.zip(sides[0].cartesian(sides[1])).map(resolve)), *sides)

    def map(self, run: Callable[[Arrays, Arrays, Arrays], object]) -> RDD:
        """``run`` of each cell with the users and the items of its blocks."""
        return self.cells.zip(self.users.cartesian(self.items)).map(lambda x: run(x[0], *x[1]))
