"""What the corpus operators share: readers, Arrow mapping, checkpoints, byte-level hashing.

Hashes are positional polynomials modulo 2**64 over a fixed random byte table. With the prefix
sums of one buffer the hash of any slice takes one subtraction and one product, so word,
n-gram and window keys come out of a few numpy passes and no loop over characters.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema  # noqa: F401

SLICE_BYTES = 1 << 20  # bytes of text handled at once; a longer text makes a slice of its own

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where all share one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fusionframe-"))
    return sc.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table of the shared folder; the shuffle files of the plan that made them go as soon as it is written.

    The table is deleted by `dropped`, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that no plan reads any more."""
    for t in tables:
        fs = t._stored_at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration())
        fs.delete(t._stored_at, True)
        fs.cancelDeleteOnExit(t._stored_at)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, types: pa.Schema) -> DataFrame:
    """mapInArrow for a function that turns a batch into column dicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in rows(batch):
                yield pa.RecordBatch.from_pydict(columns, schema=types)

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, columns: list[str]) -> str:
    """DDL of some columns."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about `limit` bytes; a long text stands alone."""
    sizes = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum(np.asarray(pa.compute.binary_length(sizes), dtype=np.int64))
    at, n = 0, len(ends)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): texts as UTF-8 one after another, each followed by a zero byte.

    starts has one more entry than there are texts; text i is bytes[starts[i]:starts[i+1]-1].
    """
    raw = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
    return np.frombuffer(b"\0".join(raw) + b"\0", np.uint8), starts


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        for k, m in enumerate((_MULT, _INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
        if n > SLICE_BYTES * 4:  # one huge text: do not keep its tables
            out = _powers[0][:n], _powers[1][:n]
            _powers[0] = _powers[1] = np.ones(1, np.uint64)
            return out
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit key."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class SpanHash:
    """Hashes of any slices of one buffer."""

    def __init__(self, data: np.ndarray):
        forward, self.back = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * forward[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end))


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals and the two-byte Latin-1 capitals as small letters; the length stays."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 32
    return out


def word_spans(data: np.ndarray, starts: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word: runs without white space, or of letters and digits."""
    inside = _ALNUM[data] if alnum else ~_SPACE[data] & (data != 0)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    edge = np.flatnonzero(np.diff(inside.view(np.int8)))
    begin, end = edge[inside[edge + 1]] + 1, edge[inside[edge]] + 1
    if inside[0]:
        begin = np.concatenate(([0], begin))
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def gram_hashes(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every n-gram that stays in one text."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h *= np.uint64(_MULT)
        h += words[k : k + m]
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return mixed(h[at]), at
