"""Vectors as blocks: one row holds some thousand vectors as bytes, so that passes over them cost little besides numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.llm.common import save

#: Numbers in a block, at most (a vector at least).
BLOCK_NUMBERS = 1 << 18


def finite(col: Column) -> Column:
    """Not null, and no component null or not finite."""
    return F.coalesce(F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def whole_numbers(col: Column, scale: int, bound: int) -> Column:
    """floor(scale * component) as bigints; products beyond ``bound`` count as it."""
    top = F.lit(float(bound))
    return F.transform(col, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, top), -top)))


def commonest_size(rows: DataFrame, col: str, divisor: int = 1) -> int:
    """The commonest length of ``col`` that ``divisor`` divides (of equally common ones the greatest); 0 without any."""
    sizes = rows.groupBy(F.size(col).alias("d")).count().filter((F.col("d") > 0) & (F.col("d") % divisor == 0))
    best = sizes.agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()["d"]
    return best or 0


def packed(spark: SparkSession, rows: DataFrame, dim: int, name: str) -> DataFrame:
    """``rows`` (``x`` array<bigint> of ``dim`` numbers, and other columns) as blocks, written and read
    back: ``x`` binary (int64, vector after vector), each other column an array, ``m`` the vectors of the block."""
    rest = [f for f in rows.schema if f.name != "x"]
    most = max(1, BLOCK_NUMBERS // max(1, dim))
    schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in rest]
                          + [T.StructField("x", T.BinaryType()), T.StructField("m", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == most:
                    yield block(held, count)
                    held, count = [], 0
        if count:
            yield block(held, count)

    def block(held: list[pa.RecordBatch], count: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = np.concatenate([p.column("x").flatten().to_numpy(zero_copy_only=False) for p in held]).astype(np.int64)
        arrays = [pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), pa.concat_arrays(table.column(f.name).chunks))
                  for f in rest]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x.tobytes()], pa.binary()), pa.array([count], pa.int32())],
                                          schema.names)

    return save(spark, rows.select(*[f.name for f in rest], "x").mapInArrow(run, schema), name)


def vectors(batch: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    """The vectors of block ``i``: vectors x dim, int64."""
    return np.frombuffer(batch.column("x")[i].as_buffer(), np.int64).reshape(-1, dim)


def totals(blocks: DataFrame, task, size: int, kind: str = "double") -> np.ndarray:
    """The sum over all blocks of ``task(batch, i)``, an array of ``size`` numbers: added up block by
    block in a task, then over tasks in a shuffle of ``size`` rows a task; ``size`` numbers reach the driver."""
    number, arrow = (np.float64, pa.float64()) if kind == "double" else (np.int64, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, number)
        for batch in batches:
            for i in range(batch.num_rows):
                own += task(batch, i)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at], arrow)], ["at", "value"])

    out = np.zeros(size, number)
    for row in blocks.mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out
