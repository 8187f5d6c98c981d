"""Text conventions, tables in the shared folder and hash helpers that the operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.scale import shared_dir

#: White space is the space and U+0009 to U+000D; a word is a run of anything else.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of ``key`` as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased; ``bytes.split`` knows the same six white-space characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def store(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
    stored._llm_path = path
    return stored


def drop_stored(stored: DataFrame) -> None:
    """Remove the files of a table that ``store`` wrote and nothing reads any more."""
    spark: SparkSession = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored._llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_key(value: Column) -> Column:
    """``value`` as a key that is never null; null stays apart from every value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def row_key(row_id: Column, text: Column) -> Column:
    """The same for rows equal in id and text, never null."""
    return F.concat_ws(":", id_key(row_id), F.xxhash64(text))


def whole_rows(df: DataFrame) -> DataFrame:
    """All columns as the one column ``_row``, so that no name can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the splitmix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Numbers(dict):
    """Numbers keys in the order they first come up."""

    def __missing__(self, key: object) -> int:
        self[key] = number = len(self)
        return number
