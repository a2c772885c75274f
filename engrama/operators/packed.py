"""Rows that travel packed: a task's rows of one block of keys are one compressed row of a shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task packs at a time, and blocks of keys at least.
ROWS, BLOCKS = 1_000_000, 256


def steps(column: pa.ChunkedArray, back: bool) -> pa.Array:
    """Whole numbers as differences to the one before, or back from these; sorted ones become small."""
    numbers = column.combine_chunks().to_numpy(zero_copy_only=False)
    return pa.array(np.cumsum(numbers) if back else np.diff(numbers, prepend=numbers.dtype.type(0)), column.type)


def coded(rows: pa.Table, keys: list[str], back: bool = False) -> pa.Table:
    for k in keys:
        if pa.types.is_int64(rows.schema.field(k).type) and not rows[k].null_count:
            rows = rows.set_column(rows.column_names.index(k), k, steps(rows[k], back))
    return rows


def compressed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(chunk: pa.BinaryScalar, keys: list[str]) -> pa.Table:
    return coded(pa.ipc.open_stream(chunk.as_buffer()).read_all(), keys, True)


def packed(rows: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """block int, rows binary: rows of equal ``keys`` are in the same block.

    The block of a pair is made of a block of either end, so that the pairs of a
    hub go to many. Blocks are as many as the session has shuffle partitions, or
    more. In a chunk rows are sorted by key and compressed; a pair of ids and a
    number takes some 3 bytes instead of 30. With ``within``, a whole number by which
    rows of a key are sorted too, equal rows of a chunk are one.
    """
    spark = rows.sparkSession
    # of each key a share of the blocks
    each = math.ceil(max(BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions"))) ** (1 / len(keys)))
    block = F.lit(0)
    for k in keys:
        block = block * each + F.pmod(F.xxhash64(k), F.lit(each)).cast("int")
    names, most, order = rows.columns, ROWS, [*keys, *([within] if within else [])]

    def chunks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if within:
            table = table.group_by(table.column_names, use_threads=False).aggregate([])
        table = table.sort_by([("__block", "ascending"), *((k, "ascending") for k in order)])
        block = table["__block"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        at, out = [], []
        for begin, end in zip(cuts, cuts[1:], strict=False):
            at.append(int(block[begin]))
            out.append(compressed(coded(table.slice(begin, end - begin).select(names), order)))
        yield pa.RecordBatch.from_arrays([pa.array(at, "int32"), pa.array(out, "binary")], names=["block", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from chunks(held)
                held, n = [], 0
        if n:
            yield from chunks(held)

    return rows.withColumn("__block", block).mapInArrow(pack, "block int, rows binary")


def listed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, a number or a text, and the distinct whole numbers ``value`` that ``rows`` have with it, in a rising list.

    Rows travel packed; neither may be null.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def gathered(chunks: pa.Table) -> pa.Table:
        found = pa.concat_tables([unpacked(x, [key, value]) for x in chunks["rows"]]).group_by([key, value], use_threads=False).aggregate([])
        found = found.sort_by([(key, "ascending"), (value, "ascending")])
        ids = found[key].combine_chunks()
        cuts = np.r_[0, np.flatnonzero(np.diff(ids.dictionary_encode().indices.to_numpy())) + 1, len(ids)]
        lists = pa.ListArray.from_arrays(pa.array(cuts, "int32"), found[value].combine_chunks())
        return pa.Table.from_arrays([ids.take(pa.array(cuts[:-1])), lists], names=[key, value])

    own = packed(rows.select(key, value), [key], value)
    return own.groupBy("block").applyInArrow(gathered, f"`{key}` {kind[key]}, `{value}` array<{kind[value]}>")


def lists_coded(rows: pa.Table, back: bool = False) -> pa.Table:
    """Lists of whole numbers, without nulls, as differences to the number before, or back from these."""
    for i, field in enumerate(rows.schema):
        if not pa.types.is_list(field.type) or field.type.value_type not in (pa.int32(), pa.int64()):
            continue
        own = rows[field.name].combine_chunks()
        at, ends = own.flatten().to_numpy(zero_copy_only=False), own.offsets.to_numpy()
        at = np.cumsum(at, dtype=at.dtype) if back else np.diff(at, prepend=at.dtype.type(0))
        rows = rows.set_column(i, field.name, pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(at)))
    return rows
