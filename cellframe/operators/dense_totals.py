"""Totals per key when a few keys hold most rows.

Keys become integer codes, every input split adds its rows into dense arrays by
bincount, and the arrays' blocks are summed through a tree of small exchanges.
A split sends one block entry however many rows a key has, so no task depends
on how the rows spread over the keys. Sums are fixed-point integers: any split
of the rows and any order of the reduction gives the same bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.runtime import fresh

BLOCK = 4096
LIMB = 26
#: Bytes of dense arrays that a task holds at most, whatever the number of keys.
HELD_BYTES = 64 << 20
PACKED = "block long, split long, payload binary"


@dataclass(frozen=True)
class Axis:
    """One part of the key. With `size` the column must lie in [0, size); otherwise its values are learned."""

    name: str
    column: Column
    size: int | None = None


def _pack(sums: np.ndarray) -> bytes:
    """Rows of a block that hold something, as slot numbers and their sums."""
    used = np.flatnonzero(sums.any(axis=0)).astype(np.int64)
    return np.concatenate([used, sums[:, used].ravel()]).tobytes()


def _unpack(payload: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(payload, np.int64)
    n = len(a) // (width + 1)
    return a[:n], a[n:].reshape(width, n)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, s, p = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(s, pa.int64()), pa.array(p, pa.binary())], ["block", "split", "payload"])


def _accumulate(values: int, scale: float, limit: float):
    """Mapper over (code, v...) batches: one entry for each block that the split touches.

    Dense arrays are held up to HELD_BYTES; of blocks beyond them each batch sends
    what it has, added up within the batch, as the reduction adds entries anyway.
    """
    width = 1 + 3 * values
    most = max(1, HELD_BYTES // (8 * width * BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, blocks = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            slots, at = np.unique(codes, return_inverse=True)
            part = np.zeros((width, len(slots)), np.int64)
            part[0] = np.bincount(at, minlength=len(slots))
            for i in range(values):
                v = batch.column(1 + i).to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(invalid="ignore", over="ignore"):
                    good = np.abs(v) <= limit
                    fixed = np.floor(np.where(good, v, 0.0) * scale + 0.5).astype(np.int64)
                # two limbs: each float sum of a batch stays below 2**53, so bincount is exact
                part[1 + 3 * i] = np.bincount(at, good, len(slots))
                part[2 + 3 * i] = np.bincount(at, fixed >> LIMB, len(slots))
                part[3 + 3 * i] = np.bincount(at, fixed & ((1 << LIMB) - 1), len(slots))
            cut = np.flatnonzero(np.diff(slots // BLOCK)) + 1
            sent = []
            for lo, hi in zip([0, *cut], [*cut, len(slots)]):
                b, at = int(slots[lo] // BLOCK), slots[lo:hi] % BLOCK
                if b not in blocks and len(blocks) < most:
                    blocks[b] = np.zeros((width, BLOCK), np.int64)
                if b in blocks:
                    blocks[b][:, at] += part[:, lo:hi]
                else:
                    sent.append((b, split, np.concatenate([at, part[:, lo:hi].ravel()]).tobytes()))
            if sent:
                yield _batch(sent)
        if blocks:
            yield _batch([(b, split, _pack(s)) for b, s in sorted(blocks.items())])

    return run


def _reduce(width: int):
    """Mapper over entries sorted by (block, split): streams each group into one array and sends its sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((width, BLOCK), np.int64)
        for batch in batches:
            ready = []
            for b, s, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (b, s) != now:
                    if now is not None:
                        ready.append((*now, _pack(sums)))
                    now, sums[:] = (b, s), 0
                used, part = _unpack(payload, width)
                sums[:, used] += part
            if ready:
                yield _batch(ready)
        if now is not None:
            yield _batch([(*now, _pack(sums))])

    return run


def _rows(values: int):
    width = 1 + 3 * values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                used, part = _unpack(payload, width)
                columns = [pa.array(used + b * BLOCK), *(pa.array(x) for x in part)]
                yield pa.RecordBatch.from_arrays(columns, ["code", "n", *(f"{k}{i}" for i in range(values) for k in ("m", "hi", "lo"))])

    return run


def dense_totals(df: DataFrame, axes: list[Axis], values: dict[str, Column], scale: float = 1e6, limit: float = 1e12, fan_in: int = 64, dictionary_limit: int = 65_536) -> DataFrame:
    """Rows and exact sums for every key, with work that doesn't follow the keys' sizes.

    Returns the axes' names, `n` (rows), and for each value `n_<name>` (values that
    count) and `sum_<name>`. A row with a null in an axis, or outside a sized axis,
    has no key: such rows come out as one row whose axes are all null. A value
    counts if it is a number of magnitude up to `limit`; null, NaN, infinite and
    larger values don't. Values are rounded to 1/scale. An empty table gives no
    rows; repeated rows all count; other columns of df are not read.

    Learned axes are collected and must have at most `dictionary_limit` values
    (64 k values of one column), and are broadcast; with more the same rows come
    from a salted two-stage aggregate instead. An axis has the type int if it is
    sized or its column is int or smaller, bigint otherwise, on both ways.
    """
    spark = df.sparkSession
    names = [a.name for a in axes]
    code, *tmp = fresh(df, "code", *(f"a{i}" for i in range(len(axes))), *(f"v{i}" for i in range(len(values))))
    cells, vals = tmp[: len(axes)], tmp[len(axes) :]
    flat = df.select(*(a.column.cast("long").alias(c) for a, c in zip(axes, cells)), *(v.cast("double").alias(c) for v, c in zip(values.values(), vals)))
    whole = ("int", "smallint", "tinyint")
    kinds = {a.name: "int" if a.size is not None or df.select(a.column).dtypes[0][1] in whole else "bigint" for a in axes}
    learned = {}
    for a, c in zip(axes, cells):
        if a.size is None:
            found = [r[0] for r in flat.select(c).where(F.col(c).isNotNull()).distinct().limit(dictionary_limit + 1).collect()]
            if len(found) > dictionary_limit:
                return _salted_totals(flat, axes, cells, list(values), vals, scale, limit, kinds)
            learned[a.name] = sorted(found)
    sizes = [a.size if a.size is not None else max(1, len(learned[a.name])) for a in axes]
    none = math.prod(sizes)
    place = F.lit(0).cast("long")
    for a, c, size in zip(axes, cells, sizes):
        if a.size is not None:
            index = F.when((F.col(c) >= 0) & (F.col(c) < size), F.col(c))
        else:
            code_of = f"{c}_i"
            table = spark.createDataFrame([(v, i) for i, v in enumerate(learned[a.name])], f"`{c}` bigint, `{code_of}` bigint")
            flat = flat.join(F.broadcast(table), c, "left")  # at most dictionary_limit rows
            index = F.col(code_of)
        place = place * size + index
    coded = flat.select(F.coalesce(place, F.lit(none).cast("long")).alias(code), *vals)
    width = 1 + 3 * len(values)
    splits = max(1, coded.rdd.getNumPartitions())
    out = coded.mapInArrow(_accumulate(len(values), scale, limit), PACKED)
    while True:
        out = out.withColumn("split", F.floor(F.col("split") / fan_in))
        out = out.repartition("block", "split").sortWithinPartitions("block", "split").mapInArrow(_reduce(width), PACKED)
        splits = math.ceil(splits / fan_in)
        if splits <= 1:
            break
    schema = "code long, n long" + "".join(f", m{i} long, hi{i} long, lo{i} long" for i in range(len(values)))
    out = out.mapInArrow(_rows(len(values)), schema)
    keys, rest = [], F.col("code")
    for a, size in reversed(list(zip(axes, sizes))):
        i = rest % size
        if learned.get(a.name):
            names_of = spark.createDataFrame([(v, k) for k, v in enumerate(learned[a.name])], f"`__v_{a.name}` bigint, `__i_{a.name}` bigint")
            out = out.withColumn(f"__i_{a.name}", i).join(F.broadcast(names_of), f"__i_{a.name}", "left")
            i = F.col(f"__v_{a.name}")
        keys.append(F.when(F.col("code") < none, i).cast(kinds[a.name]).alias(a.name))
        rest = F.floor(rest / size)
    sums = [c for i, v in enumerate(values) for c in (F.col(f"m{i}").alias(f"n_{v}"), _total(F.col(f"hi{i}"), F.col(f"lo{i}"), scale).alias(f"sum_{v}"))]
    return out.select(*reversed(keys), "n", *sums)


def _total(hi: Column, lo: Column, scale: float) -> Column:
    whole = hi.cast("decimal(28,0)") * F.lit(1 << LIMB).cast("decimal(9,0)") + lo.cast("decimal(28,0)")
    return whole.cast("double") / F.lit(scale)


def _salted_totals(flat, axes, cells, values, vals, scale, limit, kinds, salts: int = 64) -> DataFrame:
    """The exact way for keys too many for arrays: partial sums by key and salt, then by key."""
    ok = F.lit(True)
    for a, c in zip(axes, cells):
        ok = ok & F.col(c).isNotNull() & (F.lit(True) if a.size is None else (F.col(c) >= 0) & (F.col(c) < a.size))
    keyed = flat.select(*(F.when(ok, F.col(c)).alias(a.name) for a, c in zip(axes, cells)), *(F.when(F.abs(F.col(c)) <= limit, F.floor(F.col(c) * scale + 0.5).cast("long")).alias(v) for v, c in zip(values, vals)))
    names = [a.name for a in axes]
    salted = keyed.groupBy(*names, F.spark_partition_id().__mod__(salts).alias("__salt"))
    first = salted.agg(F.count("*").alias("n"), *(x for v in values for x in (F.count(v).alias(f"n_{v}"), F.sum(F.col(v).cast("decimal(38,0)")).alias(f"s_{v}"))))
    both = first.groupBy(*names).agg(F.sum("n").alias("n"), *(x for v in values for x in (F.sum(f"n_{v}").alias(f"n_{v}"), F.sum(f"s_{v}").alias(f"s_{v}"))))
    return both.select(*(F.col(a.name).cast(kinds[a.name]) for a in axes), "n", *(x for v in values for x in (F.col(f"n_{v}"), (F.coalesce(F.col(f"s_{v}").cast("double"), F.lit(0.0)) / scale).alias(f"sum_{v}"))))
