"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return in it.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local session may lack it; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read any more."""
    spark = df.sparkSession
    folder = shared_folder(spark).removeprefix("file:").lstrip("/")
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
        if folder in file:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            break


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each led by underscores until df has no column like it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[int, int, list]]:
    """Runs of rows whose column of bytes holds about `most` bytes: start, end, values."""
    values = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
    block = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(values)], strict=True):
        yield int(start), int(end), values.slice(start, end - start).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, most: int = 1_000_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
