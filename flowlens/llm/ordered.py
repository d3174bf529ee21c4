"""Numbers of rows within their groups, where neither a group nor the table is sorted in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import written


def numbered(df: DataFrame, group: str, order: list[str], keep: list[str], name: str = "n") -> DataFrame:
    """keep, `group` and name: each row's number from 0 in its group (a string column, not null), by `order`; ties in any order.

    Rows are dealt to sorted ranges of (group, order), so a hot group lies in many of them; each task numbers what it
    gets as it streams by. What earlier ranges hold of a range's first group, one number for each range, is added.
    """
    columns = [group, *dict.fromkeys(c for c in keep if c != group)]
    sides = [c for c in order if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, last, seen, at = TaskContext.get().partitionId(), None, None, 0, 0
        for batch in batches:
            g = batch.column(0)
            if not len(g):
                continue
            head = g[0].as_py() if head is None else head
            new = np.ones(len(g), bool)
            new[1:] = pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False)
            new[0] = g[0].as_py() != last
            place = np.arange(len(g))
            number = place - np.maximum.accumulate(np.where(new, place, 0))
            if not new[0]:  # the group of the batch before goes on
                own = np.flatnonzero(new)
                number[: own[0] if len(own) else len(g)] += seen
            seen, last = int(number[-1]) + 1, g[len(g) - 1].as_py()
            lead = pc.equal(g, head)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(number), lead, pa.array(np.full(len(g), part, np.int32)), pa.array(at + place)], names=[*columns, "_n", "_lead", "_part", "_at"])
            at += len(g)

    ranged = df.select(*columns, *sides).repartitionByRange(F.col(group), *[F.col(c) for c in order]).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*columns).dtypes)
    local = written(ranged.mapInArrow(run, f"{schema}, _n long, _lead boolean, _part int, _at long"), "numbered")
    edges = local.groupBy("_part").agg(F.min(F.when(F.col("_lead"), F.col(group))).alias("first"), F.max_by(group, "_at").alias("last"), F.max_by("_n", "_at").alias("n")).orderBy("_part").collect()  # one row for each range
    carry, held, total = [], None, 0
    for e in edges:
        carry.append((e["_part"], total if e["first"] == held else 0))
        total = e["n"] + 1 + (carry[-1][1] if e["first"] == e["last"] else 0)
        held = e["last"]
    bases = F.broadcast(df.sparkSession.createDataFrame(carry, "_part int, _base long"))
    out = local.join(bases, "_part")
    return out.withColumn(name, F.col("_n") + F.when(F.col("_lead"), F.col("_base")).otherwise(F.lit(0))).select(*columns, name)
