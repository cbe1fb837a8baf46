"""What several operators share: column shaping, bounded bitmaps, words as numpy arrays.

Word and gram hashes are 64 bits wide.  Bitmaps have a fixed size, whatever the
corpus: a set bit only says "maybe", so they spare work and never decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import top_per_group

# Bits of a broadcast bitmap: one megabyte.
BITMAP_BITS = 1 << 23
_BUCKET = 32768
# Bytes of text that are hashed at once; a longer text is one group of its own.
GROUP_BYTES = 2 << 20

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, taken by position so that repeated names do no harm."""
    names = df.columns
    at = {c: names.index(c) for c in columns}
    return df.toDF(*[f"_c{i}" for i in range(len(names))]).select(*[F.col(f"_c{i}").alias(c) for c, i in at.items()])


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns ``_c0, _c1, ...``, so that no name can clash; ``named`` undoes it."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[f"_c{i}" for i in range(len(like.columns))]).toDF(*like.columns)


def keyed(df: DataFrame) -> DataFrame:
    """``numbered`` rows with the two hashes of ``row_key``, named ``k1`` and ``k2``."""
    at = [f"_c{df.columns.index(c)}" for c in ("doc_id", "text")]
    return numbered(df).withColumns({"k1": F.xxhash64(*at), "k2": F.hash(*at)})


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly when the scan gives fewer tasks than the cluster has slots."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def bitmap_of(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the low bits of ``column``; at most ``bits / 8`` bytes reach the driver."""
    low = F.col(column).bitwiseAND(bits - 1)
    rows = (
        hashes.where(F.col(column).isNotNull()).select(low.alias("b"))
        .groupBy(F.expr(f"b div {_BUCKET}").alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg(b % {_BUCKET})").alias("bytes"))
        .collect()  # at most bits / 32768 rows of four kilobytes
    )
    out = np.zeros(max(bits, _BUCKET) // 8, dtype=np.uint8)
    for bucket, data in rows:
        at = bucket * _BUCKET // 8
        out[at: at + _BUCKET // 8] = np.frombuffer(bytes(data), dtype=np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes.astype(U, copy=False) & U(len(bitmap) * 8 - 1)
    return (bitmap[(low >> U(3)).astype(np.int64)] >> (low & U(7)).astype(np.uint8)) & 1 == 1


# --------------------------------------------------------------------------
# words


def _table(spaces_only: bool) -> np.ndarray:
    """Which bytes are part of a word, after lower-casing A-Z."""
    b = np.arange(256)
    if spaces_only:
        return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    return ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)


NOT_SPACE = _table(True)
WORD = _table(False)
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, GROUP_BYTES + 1)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            a = np.full(size, U(base))
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all of them."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``start:end``, the same wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    """The words of a group of texts: byte ranges, hashes, and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = batch.column(name).fill_null("").cast(pa.large_binary())
    n = len(col)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset: col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offs


def groups(raw: np.ndarray, offs: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


def words_of(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts in ``data``, A-Z lower-cased."""
    data = LOWER[data]
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offs[(offs > 0) & (offs < len(data))]
    begins[edges] = inside[edges]  # a word never runs on into the next text
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = range_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, dtype=U)
    return Words(data, start, end, hashes, np.searchsorted(start, offs))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words, in order; the last ``k - 1`` places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    for j in range(k):
        out += hashes[j: j + n] * U(pow(_MULT, 2 * j + 3, 1 << 64))
    return mix(out + U(k))


def thinned(df: DataFrame, key: Column, total: int, wanted: int) -> DataFrame:
    """Rows whose hash is among the lowest part, about twice ``wanted`` of ``total`` rows.

    A sample of the smallest hashes is taken from these, so that what reaches
    its last task does not grow with the number of tasks before.
    """
    part = min(1.0, (2 * wanted + 100) / max(1, total))
    return df if part == 1.0 else df.where(F.pmod(key, F.lit(1 << 31)) < int(part * (1 << 31)))


def smallest(df: DataFrame, group: list[str], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of every group, in two steps so that no task sees all tasks' candidates."""
    once = top_per_group(df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))), [*group, "_salt"], order, n).drop("rank")
    return top_per_group(once, group, order, n).drop("rank", "_salt")


class Shipped:
    """A broadcast value whose class travels along, as workers need no copy of this package."""

    def __init__(self, handle):
        self._handle = handle

    @property
    def value(self):
        return cloudpickle.loads(self._handle.value)


def broadcast(spark: SparkSession, value) -> Shipped:
    return Shipped(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def row_key() -> list[Column]:
    """Two hashes that stand for a row's id and text; equal rows have equal keys."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.hash("doc_id", "text").alias("k2")]
