"""Blocks of a large table streamed past lanes of a smaller one.

A lane is one packed row of bounded size.  Every lane is copied to a fixed number of parts; the blocks meant for it
are dealt over these parts by their name, behind the copy of the lane.  A task so holds one lane and one block at a
time, whatever the size of both tables, and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import parts_of

BLOCKS_A_TASK = 1024


def parts_for(blocks: int, lanes: int, cores: int) -> int:
    """Parts of a lane: enough tasks for the cluster, never more blocks than ``BLOCKS_A_TASK`` in one."""
    return max(1, -(-blocks // BLOCKS_A_TASK), min(blocks, -(-cores // max(lanes, 1))))


def laid(lanes: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """``lanes`` (lane, small) and ``blocks`` (lane, name, large) as rows sorted by lane, part and side: a lane, then its blocks."""
    left = lanes.select("lane", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"), "small",
                        F.lit(None).cast(blocks.schema["large"].dataType).alias("large"))
    right = blocks.select("lane", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("side"),
                          F.lit(None).cast(lanes.schema["small"].dataType).alias("small"), "large")
    n = parts_of(lanes.sparkSession)
    return left.unionByName(right).repartition(n, "lane", "part").sortWithinPartitions("lane", "part", "side")


def streamed(rows: DataFrame, begin: Callable, step: Callable, end: Callable, schema: pa.Schema, sql: str) -> DataFrame:
    """For each lane ``begin(lane, small)`` gives a state, ``step(state, large)`` takes a block in, ``end(state)`` gives columns.

    ``step`` may give columns too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns):
            if columns is not None and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        state = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if row.column("side")[0].as_py() == 0:
                    if state is not None:
                        yield from out(end(state))
                    state = begin(row.column("lane")[0].as_py(), row.column("small")[0].as_py())
                elif state is not None:
                    yield from out(step(state, row.column("large")[0].as_py()))
        if state is not None:
            yield from out(end(state))

    return rows.mapInArrow(run, sql)
