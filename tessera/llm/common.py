"""What several operators share: materialised tables, bounded Arrow slices, word hashes."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import fresh_path, removed

#: Bytes of text that a Python worker expands into numpy arrays at a time.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, with no lineage behind it.

    Later stages read the files again when an executor is lost, so they stay until the ``scratch``
    around the query ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed_table(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing will read again."""
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        removed(table.sparkSession, folder)


@dataclass
class Packed:
    """Rows with the columns an operator reads under its own names, and all others in the struct ``rest``, where their names can't clash."""

    frame: DataFrame
    columns: list[str]
    named: dict[str, str]

    def restored(self, df: DataFrame, added: Mapping[str, Column] | None = None) -> DataFrame:
        """``df`` with the input's columns in their order, without those of the names in ``added``, and then ``added``."""
        added = added or {}
        own = [(F.col(self.named[c]) if c in self.named else F.col("rest")[c]).alias(c) for c in self.columns if c not in added]
        return df.select(*own, *[column.alias(name) for name, column in added.items()])


def packed(df: DataFrame, **read: str) -> Packed:
    """``df`` packed; ``read`` maps an operator's name to the column that it reads."""
    named = {column: name for name, column in read.items()}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in named]
    first = [F.col(f"`{column}`").alias(name) for name, column in read.items()]
    return Packed(df.select(*first, F.struct(*rest, F.lit(0).alias("packed " + "_".join(df.columns))).alias("rest")), df.columns, named)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def hashed_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of the values of a string array without nulls, equal in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


_BASE = 0x9E3779B97F4A7C15
#: Bytes of words that are hashed together.
_RUN = 1 << 18


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of _BASE and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        power = np.full(_RUN + 1, base, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power))
    return mixed(np.arange(1, 257, dtype=np.uint64)), *out


def hashed_words(values: pa.Array) -> np.ndarray:
    """64-bit hashes of the values of a string array without nulls, equal in every process; for words, all of them at once from prefix sums of a polynomial in their bytes."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.empty(0, np.uint8)
    byte, up, down = _powers()
    out, at = np.empty(len(values), np.uint64), 0
    while at < len(values):
        end = int(np.searchsorted(offsets, offsets[at] + _RUN, "right")) - 1
        if end <= at:  # one longer than a run
            out[at], at = hashed_strings(values.slice(at, 1))[0], at + 1
            continue
        own = byte[data[offsets[at] : offsets[end]]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)])])
        first, last = offsets[at:end] - offsets[at], offsets[at + 1 : end + 1] - offsets[at]
        out[at:end] = mixed((sums[last] - sums[first]) * down[first] + mixed((last - first).astype(np.uint64) + np.uint64(1)))
        at = end
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with at most ``most`` bytes in ``column``, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def by_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, most: int = SLICE_BYTES) -> Callable:
    """A function for mapInArrow that applies ``work`` to bounded slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return run
