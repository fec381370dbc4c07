"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define words: 0x20 and 0x09-0x0D.
_SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; a folder of our own only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="hornlog-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Let shuffle files of ended jobs go now: the driver drops them only when it collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones never clash; whole numbers as 64 bits.  Arrow batches are kept to a few MB."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    kinds = dict(df.dtypes)
    return df.select(*[F.col(f"`{n}`").cast("bigint").alias(n) if kinds[n] in ("tinyint", "smallint", "int") else F.col(f"`{n}`") for n in names])


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id, which therefore is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def crc_fold(doc_id: int | None, modulus: int) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


#: Lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words between runs of ASCII white space; null has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(ASCII_LOWER) if lower else raw).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def _byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE = _byte_set(b" \t\n\v\f\r")
NEWLINE = _byte_set(b"\n")
_PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = mix64(np.arange(1, 513, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(2, 256)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (_ODD, _ODD_INVERSE)]
    return _powers[0], _powers[1]


class Segments:
    """The segments (words, lines) of many texts at once, by 64-bit hashes of their bytes.

    ``starts`` has where each text's segments begin in ``hash``, and one more
    entry; ``first`` and ``end`` are byte places in ``raw``, which is all texts
    joined by a separator.  ``second`` asks for another 64 bits in ``hash2``.
    Work goes in pieces of a few MB, so that memory follows the text itself.
    """

    def __init__(self, texts: list[str | None], apart: np.ndarray = SPACE, lower: bool = False, second: bool = False):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined = (b" " if apart[32] else b"\n").join(parts)
        self.bytes = joined.translate(ASCII_LOWER) if lower else joined
        self.raw = np.frombuffer(self.bytes, np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))])
        free = apart[self.raw]
        out = {k: [] for k in ("first", "end", "hash", "hash2")}
        a = 0
        while a < len(self.raw):
            b = min(len(self.raw), a + _PIECE)
            while b < len(self.raw) and not free[b]:  # never inside a segment
                more = free[b : b + _PIECE]
                b += int(more.argmax()) if more.any() else len(more)
            self._piece(a, b, free[a:b], second, out)
            a = b
        self.first, self.end = (np.concatenate([np.empty(0, np.int64), *out[k]]) for k in ("first", "end"))
        self.hash, self.hash2 = (np.concatenate([np.empty(0, np.uint64), *out[k]]) for k in ("hash", "hash2"))
        self.starts = np.searchsorted(self.first, self.text_at)
        self.n = np.diff(self.starts)

    def _piece(self, a, b, free, second, out) -> None:
        edge = np.flatnonzero(np.diff(np.concatenate([[True], free, [True]]).view(np.int8)))
        first, end = edge[::2], edge[1::2]
        up, down = _power_tables(b - a + 1)
        with np.errstate(over="ignore"):
            for k in range(1 + second):
                total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_CODES[k][self.raw[a:b]] * up[: b - a])])
                h = (total[end] - total[first]) * down[first]
                out["hash2" if k else "hash"].append(mix64(h + (end - first).astype(np.uint64)))
        out["first"].append(first + a)
        out["end"].append(end + a)

    def which(self) -> np.ndarray:
        """The number of the text that each segment is of."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def per_text(self, weights: np.ndarray) -> np.ndarray:
        """Sums of a weight for each segment, by text."""
        return sums(weights, self.starts)

    def bytes_per_text(self, wanted: np.ndarray) -> np.ndarray:
        """How many bytes of each text are wanted (a flag for each byte of ``raw``)."""
        return sums(wanted, np.minimum(self.text_at, len(self.raw)))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def sequence_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` successive entries."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if width > 8:  # by differences of prefix sums
            up, down = _power_tables(len(h) + 1)
            total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
            return mix64((total[width:] - total[:n]) * down[:n])
        out = h[:n].copy()
        for k in range(1, width):
            out = out * _ODD + h[k : n + k]
        return mix64(out)


def inside(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the n - width + 1 successive windows stay within one text."""
    keep = np.ones(max(0, n - width + 1), bool)
    for k in range(1, width):
        at = starts[1:-1] - k
        keep[at[(at >= 0) & (at < len(keep))]] = False
    return keep


def _give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after whose last batch a worker gives its memory back before it goes on to another task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pools keep more of what was freed
        yield from run(batches)
        _give_back()

    return wrapped


def bounded(batches: Iterator[pa.RecordBatch], text_column: int = 1, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, so that memory does not follow the batch size."""
    for batch in batches:
        column = batch.column(text_column)
        lens = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], np.int64) if len(column) else np.empty(0, np.int64)
        a, total = 0, np.cumsum(lens)
        while a < len(lens):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b
        _give_back()
