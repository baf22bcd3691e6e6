"""What the operators share: words, checkpoints, and Arrow passes that keep a key column's type."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.plans.session import saved, with_checkpoints, with_small_batches

__all__ = ["saved", "with_checkpoints"]

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() cuts at exactly the ASCII white space of WORD."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z; bytes.lower() leaves all other characters alone."""
    return text.encode().lower().split() if text else []


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key's text modulo modulus; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def in_training(key: Column, modulus: int, held: int) -> Column:
    """Whether a row may be learned from; a null key never is."""
    return F.coalesce(remainder(key, modulus) != held, F.lit(False))


def is_held_out(key: Column, modulus: int, held: int) -> Column:
    """Whether a row belongs to the held-out fold; a null key counts as held out, as nothing is learned from it."""
    return ~in_training(key, modulus, held)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the text alone, as `key` and `text` (null text: empty); other columns can't clash, of columns of one name the first counts."""
    with_small_batches(docs.sparkSession)
    rows, names = numbered_columns(docs)
    return rows.select(F.col(names[key]).alias("key"), F.coalesce(F.col(names[text]).cast("string"), F.lit("")).alias("text"))


def text_pass(
    rows: DataFrame, fields: list[T.StructField], each: Callable[[list[str | None]], list[pa.Array]], text: str = "text", keep: bool = False
) -> DataFrame:
    """rows with fields added, which each() makes of a batch of texts; the text column goes unless keep is set."""
    with_small_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if keep or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                out = each(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + out, [f.name for f in kept + fields])

    return rows.mapInArrow(run, T.StructType(kept + fields))


class Names(list):
    """(old name, new name) of each column in order; old names may repeat. names[old] is the new name of the first."""

    def __getitem__(self, old: str) -> str:
        return next(new for o, new in self if o == old)


def numbered_columns(df: DataFrame) -> tuple[DataFrame, Names]:
    """df with columns named c0, c1, ..., which clash with nothing an operator adds, and their names."""
    names = Names((c, f"c{i}") for i, c in enumerate(df.columns))
    return df.toDF(*[new for _, new in names]), names


def copied(rows: DataFrame, n: str, number: str, at_once: int = 4096) -> DataFrame:
    """Each row as often as its long column n says, numbered from 0; copies are made a bounded number at a time."""
    firsts = F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(at_once).cast("long"))
    parts = rows.where(F.col(n) > 0).select("*", F.explode(firsts).alias("_first"))
    return parts.select("*", F.explode(F.sequence("_first", F.least(F.col(n), F.col("_first") + at_once) - 1)).alias(number)).drop("_first")


def small_batches(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that Python objects exist for a few texts at a time."""
    for at in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(at, rows)
