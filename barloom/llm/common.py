"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.lineage import scratch, settle

__all__ = ["documents", "fresh", "held_out", "scratch", "settle", "slices", "small", "with_columns", "WORD", "WORD_TEXT"]

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_TEXT = re.compile(r"[^\x20\x09-\x0D]+")
#: A table is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table with a broadcast hint if its counted size allows one; joins shuffle it otherwise."""
    kept = settle(frame)
    return F.broadcast(kept) if kept.count() <= rows else kept


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until no existing column has it, whatever the case."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the quarter of ids kept from training; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts (or lists) of one hold about `most` bytes (or items); a single longer one stays whole."""
    for batch in batches:
        first, held, values = 0, 0, batch.column(column)
        sizes = pc.list_value_length(values) if pa.types.is_nested(values.type) else pc.binary_length(values)
        for k, size in enumerate(sizes.to_pylist()):
            if held and held + (size or 0) > most:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += size or 0
        if first < batch.num_rows:
            yield batch.slice(first)


def with_columns(
    docs: DataFrame,
    text: str,
    carry: Sequence[str],
    made: Sequence[tuple[str, str, pa.DataType]],
    work: Callable[..., Sequence],
    also: Sequence[str] = (),
) -> DataFrame:
    """Columns `carry` as they are (they stay Arrow arrays, whatever their types), and those that `work` makes of the texts.

    `made` has name, Spark type and Arrow type of each; `work` takes the list of texts (and those of the columns `also`) and
    gives a list for each.
    """
    names = [*carry, *(n for n, _, _ in made)]
    kinds = [*(docs.schema[c].dataType.simpleString() for c in carry), *(k for _, k, _ in made)]
    types = [t for _, _, t in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            columns = work(*(batch.column(c).to_pylist() for c in (text, *also)))
            new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *new], names)

    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select(*dict.fromkeys([*carry, text, *also])).mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
