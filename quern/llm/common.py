"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches and are turned into flat numpy arrays: one code for each word,
plus the offsets of every document. No loop runs over words.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc
    _LIBC = None
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves a ``local`` master, whose executors are this process; any other master is
    refused, since its executors couldn't read a folder of this machine.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = os.path.join(tempfile.gettempdir(), "quern-checkpoints")
        spark.sparkContext.setCheckpointDir(at)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches that go to Python have at most about ``most`` bytes in plans that run meanwhile; Spark's own bound is 10,000 rows, of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def pieces(n_bytes: int, each: int, least: int = 1) -> int:
    return int(max(least, -(-n_bytes // each)))


#: rows to drop beyond this count are joined by a shuffle instead of a broadcast
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (a table that has been cut), to be broadcast if it has few rows and joined by a shuffle otherwise."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def text_key(text: Column) -> Column:
    """Tells rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64(text)


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by ``doc_id`` and ``k``, the ``text_key``.

    Rows with a null ``doc_id`` or text stay, and so do rows of the same ``doc_id`` with another text. ``gone`` is written to the
    shared folder and counted: a small one is broadcast, so that texts need no shuffle; a larger one is joined by a shuffle.
    """
    gone = cut(gone.select(F.col("doc_id").cast("long").alias("__id"), F.col("k").alias("__k")).distinct())
    return docs.join(small(gone), (docs["doc_id"].cast("long") == gone["__id"]) & (text_key(docs["text"]) == gone["__k"]), "left_anti")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer over uint64 arrays."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def hash_strings(values: list[str] | np.ndarray) -> np.ndarray:
    """A uint64 hash for each string; the same in every process."""
    if not len(values):
        return np.zeros(0, U64)
    return pd.util.hash_array(np.asarray(values, dtype=object), categorize=False).astype(U64)


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 2 << 20, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``limit`` bytes of text, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total, start = np.cumsum(size), 0
    while start < len(size):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        end = min(end, start + rows)
        yield batch.slice(start, end - start)
        start = end


def words(texts: pa.Array, lower: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, a code for each word, and offsets of the documents into the codes.

    Words are the non-empty stretches between Unicode white space. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.utf8_split_whitespace(texts)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = np.asarray(coded.indices).astype(np.int32)
    if "" in distinct:
        keep = codes != distinct.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return distinct, codes, offsets


def trim() -> None:
    """Give freed memory back to the system, so that a reused worker stays small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + c)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string; ``unpack`` needs the same dtypes."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    counts, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(counts, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def six(x: np.ndarray) -> np.ndarray:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def unsix(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; it sizes exchanges and decides nothing else."""
    return int(df.agg(F.sum(F.octet_length(df[column]).cast("long"))).first()[0] or 0)


def bits_for(n_bytes: int, each: int, most: int = 28) -> int:
    """Bits of a bucket number so that a bucket holds about ``each`` bytes; 28 bits are enough for petabytes and still leave
    bucket numbers 32 bits."""
    return min(most, max(0, (-(-n_bytes // each) - 1).bit_length()))


def binary_rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column over one byte array, cut by sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return values.cast(pa.binary())
