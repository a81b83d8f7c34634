"""Helpers shared by the training-data operators: words, Arrow batches and
intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows and bytes of one Arrow batch handed to Python.
BATCH_ROWS = 2048
BATCH_BYTES = 32 << 20

# In UTF-8 every byte of a character beyond ASCII is >= 0x80, so this class on
# lower-cased bytes takes the same words as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on
# characters. bytes.lower() changes A-Z only.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes; none for null."""
    return _WORD.findall(text.lower()) if text else []


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the words."""
    return [m.span() for m in _WORD.finditer(text.lower())]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it holds ``bound`` words."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


_kept: dict[tuple, object] = {}


def kept[T](owner: tuple, make: Callable[[], T]) -> T:
    """What this worker keeps between tasks for ``owner``. It keeps the things
    of one owner at a time: those of an operator that ran before are dropped."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def arrow_limits(spark: SparkSession) -> None:
    """Bound the batches that this session hands to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kinfold-llm/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write an intermediate table into the shared folder and read it back:
    the lineage ends there and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete intermediate tables that this library wrote and no longer reads."""
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)


#: Keys that hold more than one in so many rows are joined by broadcast: at most as many keys.
HOT = 1000


def spread_join(rows: DataFrame, registry: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the one row of ``registry`` for their key, whose ``count`` is the
    number of rows of that key among ``total``. Keys with more than a thousandth
    of the rows (so fewer than 1000 of them) go by broadcast, the others by shuffle.
    Keys are not null."""
    hot = F.col(count) * HOT > total
    heavy = F.broadcast(registry.where(hot))
    return rows.join(heavy, key).unionByName(
        rows.join(heavy.select(key), key, "left_anti").join(registry.where(~hot), key))


def whole_row(df: DataFrame) -> F.Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal keys that follow each other."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *names)), strict=True):
            k = row[:len(keys)]
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(row[len(keys):])
    if held:
        yield key, held


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()
