"""Shared helpers: work folders, Arrow text chunks and vectorised 64-bit hashing of words and bytes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold few rows because one text can be very long.
ARROW_ROWS = 1024
ARROW_DEFAULT = "10000"
#: Texts are hashed in chunks of about this many bytes, so that the arrays stay in cache.
CHUNK_BYTES = 1 << 20

# fixed values: ASCII white space that separates words, and the symbols that quality rules count
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Where none is named, a session in one process gets a local one; on a cluster that is an error, as executors would
    write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="partloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write as Parquet to the shared folder and read it again. Survives the loss of executors."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    if not _folders:
        atexit.register(_clean)
    _folders[path] = spark
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_folder = path
    return out


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan needs any more: Spark deletes them when the driver's garbage is collected, which
    otherwise happens whenever its memory fills up, and disks may fill up first."""
    gc.collect()
    spark._jvm.System.gc()


#: Work folders that exist, and the sessions that wrote them.
_folders: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_work_folder", None)
        if path in _folders:
            _delete(_folders.pop(path), path)


def _clean() -> None:
    """At the end of the process: results have been read by then."""
    for path, spark in list(_folders.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone, and its folder with it
            pass
    _folders.clear()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows where nobody has set their size; a value that is set stays, and results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == ARROW_DEFAULT:
        spark.conf.set(key, str(ARROW_ROWS))


def by_place(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns named by their place, so that no name can clash, and the original names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), list(df.columns)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores in front until no column of that name is taken."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def rows_for_broadcast(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. For pure ASCII the fast built-in does the same."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


# --- vectorised hashing -------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (public domain), on whole arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


class Roller:
    """Polynomial hashes modulo 2**64 of any span, from prefix sums; the odd base has an inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.forget()

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up), CHUNK_BYTES + 8)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of values[start:end]."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Mixed hashes of every k consecutive values."""
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


WORD_ROLLER, GRAM_ROLLER, SPAN_ROLLER = Roller(0x9E3779B97F4A7C15), Roller(0xD6E8FEB86659FD93), Roller(0xA0761D6478BD642F)


def give_back() -> None:
    """Let go of tables that are soon made again, and of memory that is free but that the allocators keep."""
    for roller in (WORD_ROLLER, GRAM_ROLLER, SPAN_ROLLER):
        roller.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with memory given back after each task: workers live on, and what one step has freed would stay with
    them through the next ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()  # not when a generator is closed, which may be in the middle of another task

    return task


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in three passes whatever w is."""
    n = len(a) - w + 1
    if n <= 0 or w == 1:
        return a[: max(n, 0)].copy()
    size = -(-len(a) // w) * w
    padded = np.full(size, np.iinfo(a.dtype).max, a.dtype)
    padded[: len(a)] = a
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) for whole rows of about size bytes."""
    data, offsets = text_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space, cut at row ends), and for each row its first word."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~IS_SPACE[data]
    step = np.diff(solid)
    begin, end = step[:-1] == 1, step[1:] == -1
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]
    begin[both] = True
    end[both - 1] = True
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def keyed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code for each word with A-Z in lower case: 64 bits of BLAKE2b over its bytes, taken once for each different word.
    Unlike those of polynomials, no texts are known whose codes collide."""
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    packed = LOWER_BYTES[data][~IS_SPACE[data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(packed.tobytes())]).dictionary_encode()
    codes = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist())
    return np.frombuffer(codes, np.uint64)[words.indices.to_numpy()]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return WORD_ROLLER.spans(WORD_ROLLER.prefix((LOWER_CODES if lower else BYTE_CODES)[data]), starts, ends)
