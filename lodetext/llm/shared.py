"""What several training-data operators share: reading tables, shared scratch space, word hashing."""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
BLANKS = " \t\n\x0b\x0c\r"

_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where it is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="lodetext-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _scopes:
        _scopes[-1].append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of save() that nothing reads any more."""
    delete(df.sparkSession, df._scratch)


@contextlib.contextmanager
def scratch():
    """A list of the folders of all tables that save() makes meanwhile."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its partitions and their order kept, in the shared checkpoint folder."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str]) -> str:
    """A prefix that no column has, for columns that are added for a while."""
    prefix = "_lt_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def id_remainder(doc_id: F.Column | str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % n


# Hashing of words ----------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, p in enumerate((_P, _P_INV)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def unmix(h: np.ndarray) -> np.ndarray:
    """What mix() made h of."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return h ^ (h >> np.uint64(33))


def _tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
    lower[65:91] += np.uint64(32)
    word = np.ones(256, bool)
    word[list(separators)] = False
    return lower, word


_LOWER = _tables(b"")[0]
_SPLITS = {
    "blank": _tables(BLANKS.encode()),
    "plain": _tables(bytes(c for c in range(128) if not chr(c).isalnum())),
}


def word_hashes(texts: list[bytes | None], split: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin (one entry more than texts).

    A-Z count as a-z. split: "blank" for words between ASCII white space, "plain" for runs of ASCII letters, digits and any
    other characters. Hashes are equal for equal words and, but for about 2**-64 a pair, differ for others.
    """
    is_word = _SPLITS[split][1]
    data = b"\n".join(t or b"" for t in texts) + b"\n"
    edge = np.flatnonzero(np.diff(is_word[np.frombuffer(data, np.uint8)].view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    at = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    return span_hashes(data, starts, ends), np.searchsorted(starts, at)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of data with A-Z as a-z: equal for equal bytes wherever they stand."""
    a = np.frombuffer(data, np.uint8)
    up, down = _power_tables(len(a))
    total = _LOWER[a]
    total *= up[: len(a)]
    np.cumsum(total, out=total)
    h = total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(starts) else np.empty(0, np.uint64)
    return mix(h * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def pack(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of integers or floats, by place: so bytes that hardly differ stand together and compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T.tobytes()


def unpack(data: bytes, width: int, kind=np.uint64) -> np.ndarray:
    out = np.zeros((len(data) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


def pack_sorted(k: np.ndarray, width: int) -> bytes:
    """Sorted unsigned integers, as their differences."""
    return pack(np.diff(k, prepend=np.uint64(0)), width)


def unpack_sorted(data: bytes, width: int) -> np.ndarray:
    return np.cumsum(unpack(data, width), dtype=np.uint64)


#: What operators keep in a Python worker from task to task, by operator: how to let go of it.
caches: dict = {}


def drop_caches(keep: str | None = None) -> None:
    """A worker that turns to another operator's task frees what the last one kept."""
    for name, clear in caches.items():
        if name != keep:
            clear()


def byte_batches(batches: Iterable, columns: list[str], most: int = 1 << 21, keep: str | None = None) -> Iterator[list]:
    """Lists of each column's values with about `most` bytes of text (the last column) at once; one long text stands alone."""
    import pyarrow as pa

    drop_caches(keep)
    try:
        yield from _byte_batches(batches, columns, most)
    finally:
        trim()


@functools.lru_cache(maxsize=1)
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives what a task has freed back to the system: a Python worker that waits for its next task holds little."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def _byte_batches(batches: Iterable, columns: list[str], most: int) -> Iterator[list]:
    import pyarrow as pa

    for b in batches:
        texts = b.column(columns[-1]).cast(pa.binary()).to_pylist()
        others = [b.column(c).to_pylist() for c in columns[:-1]]
        start, size = 0, 0
        for k, t in enumerate(texts):
            n = len(t or b"")
            if size and size + n > most:
                yield [x[start:k] for x in others] + [texts[start:k]]
                start, size = k, 0
            size += n
        if start < len(texts):
            yield [x[start:] for x in others] + [texts[start:]]
