"""What the operators share: reading, cutting lineage in the shared folder, words as hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_MULT, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

#: Of what a Python worker is sent at once, rows, whole documents mostly, and bytes, at most.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = named.get() if named.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended already; the folder is the cluster's to clean
        pass


_homes: dict[str, str] = {}


def written(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage is cut, and lost executors cost nothing.

    free: gives back what the plan's shuffles hold on disk, which isn't worth it after a small one.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _homes:
        _homes[app] = f"{shared_dir(spark)}/plandrift-{uuid.uuid4().hex}"
        atexit.register(_remove_at_exit, spark, _homes[app])
    path = f"{_homes[app]}/{name}-{uuid.uuid4().hex[:12]}"
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if free:
        # The plan is done with: its shuffle files go with its last reference, when the driver's garbage is collected, which
        # by itself may take half an hour. Listeners hold on to the last execution until another one comes along.
        gc.collect()
        spark.range(1).count()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def portions(texts: list[str | None], most: int = 1 << 18) -> Iterator[slice]:
    """Slices of texts of about ``most`` characters each, so that what is made of one stays small; a longer text is alone."""
    begin = held = 0
    for k, t in enumerate(texts):
        n = len(t or "") + 64
        if held and held + n > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def tidy(run: Callable) -> Callable:
    """run, a function from batches to batches, which at its end gives freed memory back: workers are kept for later tasks."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied


def release() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Splitmix64's finaliser over uint64, for each seed another bijection."""
    x = x + U64(((seed + 1) * _MULT) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.empty(max(n, 1), U64)
    out[0], have = 1, 1
    while have < n:
        step = U64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out[:n]


def words_of(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of whole texts (null: none), with A-Z lower-cased.

    Returns a 64-bit hash for each word, the first word's index for each text and one past the last's,
    and each word's first and end byte within its text: (hashes, bounds, starts, ends).
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    if lower:
        flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((flat.astype(U64) + U64(1)) * powers(_MULT, len(flat)))])
    back = powers(_INVERSE, len(flat) + 1)
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64)) if len(starts) else np.zeros(0, U64)
    bounds = np.searchsorted(starts, begins)
    own = np.repeat(begins[:-1], np.diff(bounds))
    return hashes, bounds, starts - own, ends - own


def shingles_of(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``width`` words within one text, and their bounds by text. Fewer words give none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out * U64(_MULT)) + hashes[k : k + n]
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    index = np.repeat(bounds[:-1] - at[:-1], counts) + np.arange(at[-1])
    return mix(out[index]), at
