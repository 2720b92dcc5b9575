"""Order inside groups of any size: for each row, what the rows before it in its group sum up to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, free_names


def _differs(column: pa.Array) -> np.ndarray:
    """For each value but the first: is it another than the one before? Two nulls are equal."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.fill_null(pc.equal(a, b), False)
    return ~np.asarray(pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False), bool)


def _sums_before(group: str, weight: str | None, names: tuple[str, str]):
    """mapInArrow function over sorted rows: appends the task's number and the sum of the earlier weights of the group in this task."""

    def run(batches):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(group))
            w = np.ones(n, np.int64) if weight is None else batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.concatenate([[last is None or keys[0].as_py() != last[0]], _differs(keys)])
            upto = np.cumsum(w)
            before = upto - w
            starts = np.flatnonzero(new)
            base = np.repeat(before[starts], np.diff(np.append(starts, n)))
            out = before.copy()
            head = starts[0] if len(starts) else n  # rows that carry on with the last batch's group
            out[:head] += total
            out[head:] -= base
            total = int(out[-1] + w[-1])
            last = (keys[n - 1].as_py(),)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(out)], names=[*batch.schema.names, *names])

    return run


def ordered(space: Workspace, rows: DataFrame, group: str, order: list[Column], before: str, weight: str | None = None) -> DataFrame:
    """rows, written as a table, with a long column `before`: the sum of `weight` (1 if None) over the earlier rows of their group.

    One range exchange by group and order deals a group of any size to many tasks; each sums up its
    own rows in a stream, and adds what the tasks before it hold of the group. Only groups that go
    on from one task into the next need that, at most one a task, so that list is broadcast with the
    number of tasks as its proven bound. Null is a group of its own. Rows that are equal in `order`
    share a task and come in any order: give an order that tells apart whatever isn't equal.
    """
    part, local, total = free_names(rows, "part", "local", "total")
    keys = [F.col(group).asc_nulls_first(), *order]
    schema = T.StructType([*rows.schema, T.StructField(part, T.IntegerType()), T.StructField(local, T.LongType())])
    cut = space.table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_sums_before(group, weight, (part, local)), schema))
    sums = cut.groupBy(group, part).agg((F.count("*") if weight is None else F.sum(weight)).alias(total))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.sum(total).over(earlier)).where(F.col(before) > 0)
    sums = sums.select(F.col(group).alias(total), F.col(part).alias(f"{part}_of"), F.col(before))
    out = cut.join(F.broadcast(sums), F.col(group).eqNullSafe(F.col(total)) & (F.col(part) == F.col(f"{part}_of")), "left")
    return out.select(*rows.columns, (F.col(local) + F.coalesce(F.col(before), F.lit(0))).alias(before))
