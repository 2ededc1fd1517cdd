"""What the operators of this subpackage share: tables, shared files, blobs of arrays and numbering."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, as a URI that Spark writes to.

    Where that setting is empty (a session of tests, on one machine) a folder of
    the machine is set; a cluster has to name one that all its nodes share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(base, exist_ok=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The mounted path of a shared folder, for files that are mapped into memory."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{uri}: mapped files need spark.checkpoint.dir on a file system that every node mounts")
    return unquote(parsed.path)


def mapped_dir(spark: SparkSession, tag: str) -> str:
    path = local_path(shared_dir(spark, tag))
    os.makedirs(path, exist_ok=True)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and read back from Parquet in the shared folder, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches of this session hold at most so many rows: of long texts, the default of 10,000 is no bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Give freed memory of this worker back to the system, where its C library can."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts(total: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` a total makes; grows with the input without a cap."""
    return max(least, -(-total // each))


# -- blobs: sorted runs of arrays that cross a shuffle as a few binary rows --------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, so that the shuffle's codec finds the zeros."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    n = len(blob) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        planes = np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def bucket_edges(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and the end."""
    width = -(-(1 << 64) // buckets)
    if buckets == 1:
        return np.array([0, len(sorted_keys)])
    starts = np.array([k * width for k in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, starts), [len(sorted_keys)]))


def save(path: str, array: np.ndarray) -> None:
    """Write a .npy file whole or not at all; a task that runs again writes the same."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        np.save(f, array)
    os.replace(temporary, path)


def mapped(path: str) -> np.ndarray:
    array = np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)
    return array if len(array) else np.load(path)


class Narrow:
    """Whole numbers, most of them under 255, a byte each; where the larger ones stand, and what they are."""

    dtype = np.dtype(np.int64)

    def __init__(self, low: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        self.low, self.place, self.value = low, place, value

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, at: np.ndarray | slice) -> np.ndarray:
        out = self.low[at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            where = (np.arange(*at.indices(len(self.low))) if isinstance(at, slice) else at)[large]
            out[large] = self.value[np.searchsorted(self.place, where)]
        return out


class SortedFiles:
    """Sorted arrays of 64-bit keys, one set of files for each range of keys, mapped and not read. Columns named narrow are counts."""

    def __init__(self, folder: str, name: str, buckets: int, columns: Sequence[str], narrow: Sequence[str] = ()) -> None:
        self.folder, self.name, self.buckets, self.columns, self.narrow = folder, name, buckets, tuple(columns), frozenset(narrow)
        self._open: dict[int, list[np.ndarray]] = {}
        self.sealed: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def seal(self, buckets: Sequence[int]) -> None:
        """These ranges have been written and no others; one of them that is not found is an error from here on."""
        have = np.zeros(self.buckets, dtype=bool)
        have[np.asarray(buckets, dtype=np.int64)] = True
        self.sealed, self._open = np.packbits(have), {}

    def path(self, bucket: int, column: str) -> str:
        return f"{self.folder}/{self.name}-{bucket:06d}-{column}.npy"

    def write(self, bucket: int, **columns: np.ndarray) -> None:
        for column in self.columns:
            array = columns[column]
            if column in self.narrow:
                large = np.flatnonzero(array >= 255)
                save(self.path(bucket, f"{column}-place"), large)
                save(self.path(bucket, f"{column}-value"), array[large].astype(np.int64))
                array = np.minimum(array, 255).astype(np.uint8)
            save(self.path(bucket, column), array)

    def _load(self, bucket: int) -> list[np.ndarray | Narrow]:
        if self.sealed is None:
            if not os.path.exists(self.path(bucket, self.columns[-1])):
                return []
        elif not self.sealed[bucket >> 3] >> (7 - (bucket & 7)) & 1:
            return []
        arrays = {c: mapped(self.path(bucket, c)) for c in self.columns}
        return [Narrow(a, *(mapped(self.path(bucket, f"{c}-{x}")) for x in ("place", "value"))) if c in self.narrow else a for c, a in arrays.items()]

    def _arrays(self, bucket: int) -> list[np.ndarray]:
        if bucket not in self._open:
            if len(self._open) > 512:  # open files, not rows: those closed are opened again
                self._open.clear()
            self._open[bucket] = self._load(bucket)
        return self._open[bucket]

    def part(self, source: int, bucket: int) -> list[np.ndarray]:
        """The rows of one set of files whose keys are in a range of the keys; for files that are each sorted but not split by range."""
        arrays = self._load(source)
        if not arrays:
            return []
        width = -(-(1 << 64) // self.buckets)
        a = int(np.searchsorted(arrays[0], np.uint64(bucket * width)))
        b = len(arrays[0]) if bucket == self.buckets - 1 else int(np.searchsorted(arrays[0], np.uint64((bucket + 1) * width)))
        return [np.array(x[a:b]) for x in arrays]

    def find(self, keys: np.ndarray, fill: Sequence[int | float], check: np.ndarray | None = None) -> list[np.ndarray]:
        """For sorted keys, whether each is there, and its other columns (where not: fill).

        With check, the second column has to equal it, too; keys may then repeat.
        """
        there = np.zeros(len(keys), dtype=bool)
        out: list[np.ndarray | None] = [None] * (len(self.columns) - 1)
        edges = bucket_edges(keys, self.buckets)
        for bucket in np.flatnonzero(np.diff(edges)):
            a, b = edges[bucket], edges[bucket + 1]
            arrays = self._arrays(int(bucket))
            if not arrays or not len(arrays[0]):
                continue
            at = np.searchsorted(arrays[0], keys[a:b])
            at[at == len(arrays[0])] = 0
            hit = arrays[0][at] == keys[a:b]
            if check is not None:
                while len(wrong := np.flatnonzero(hit & (arrays[1][at] != check[a:b]))):
                    after = np.minimum(at[wrong] + 1, len(arrays[0]) - 1)
                    same = (after > at[wrong]) & (arrays[0][after] == keys[a:b][wrong])
                    at[wrong[same]] = after[same]
                    hit[wrong[~same]] = False
            there[a:b] = hit
            for k, values in enumerate(arrays[1:]):
                if out[k] is None:
                    out[k] = np.full(len(keys), fill[k], dtype=np.int64 if values.dtype.kind in "iu" else values.dtype)
                out[k][a:b][hit] = values[at[hit]]
        return [there, *(np.full(len(keys), fill[k]) if x is None else x for k, x in enumerate(out))]


# -- numbering ---------------------------------------------------------------------------------


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, buckets: int) -> DataFrame:
    """Adds `name`: the sum of value over the rows before, within keys, without one task for a group.

    Rows are dealt to `buckets` by a hash of the order columns, summed within each
    bucket, and shifted by what the buckets before hold. The order columns have to
    tell all rows of a group apart, and the keys to have few values: the table
    of shifts, which is broadcast, has at most that many values times `buckets` rows.
    df is computed twice, so hand in a written table.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int")).withColumn("_v", value.cast("long"))
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_sb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("_b") == F.col("_sb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.withColumn("_own", F.coalesce(F.sum("_v").over(inner), F.lit(0))).join(F.broadcast(shift), on)
    return out.withColumn(name, F.col("_own") + F.col("_shift")).drop("_b", "_v", "_own", "_sb", "_shift", *[f"_k{i}" for i in range(len(keys))])
