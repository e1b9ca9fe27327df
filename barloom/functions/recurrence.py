"""First-order linear recurrences y[t] = q*y[t-1] + b[t] without Python.

A block of rows is a plain running sum of b*q**-pos scaled back by q**pos. Its length follows from q: long enough that
q**length is below 1e-30, so that only the last value of the previous block can matter in double precision, and short
enough that q**-length stays a double. Any q between 0 and 1 has such a length. Terms whose q allows the common length
share a window. All windows share the partitioning of the key, so a recurrence adds local sorts but no shuffle.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import KEYS

BLOCK = 1024


def block_length(q: float) -> int:
    """Rows of a block: the common length if q**length lies between 1e-250 and 1e-30, else that of about 1e-200."""
    if not 0.0 < q < 1.0:
        raise ValueError(f"decay {q} outside (0, 1)")
    digits = -log(q) / log(10)
    return BLOCK if 30 <= BLOCK * digits <= 250 else max(1, int(200 / digits))


def linear(df: DataFrame, terms: dict[str, tuple[str, float]], keys=KEYS, seq="seq", keep_blocks=False) -> DataFrame:
    """Add one column per entry of `terms` (name -> (input column, q)). `seq` numbers the rows of a key from 0.

    `keep_blocks` leaves the block column in place, so that a following recurrence finds the rows already sorted.
    """
    lengths = {block_length(q) for _, q in terms.values()}
    if lengths != {BLOCK}:
        for length in sorted(lengths):
            some = {y: (b, q) for y, (b, q) in terms.items() if block_length(q) == length}
            df = _blocks(df, some, keys, seq, length, keep_blocks and length == BLOCK)
        return df
    return _blocks(df, terms, keys, seq, BLOCK, keep_blocks)


def _blocks(df: DataFrame, terms: dict[str, tuple[str, float]], keys, seq: str, length: int, keep_blocks: bool) -> DataFrame:
    """The recurrences whose blocks have `length` rows."""
    block = "_block" if length == BLOCK else f"_block_{length}"
    pos = F.col(seq) % length
    if block not in df.columns:
        df = df.withColumn(block, F.floor(F.col(seq) / length).cast("long"))
    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    df = df.select(
        "*",
        *[
            (F.pow(F.lit(q), pos) * F.sum(F.col(b) * F.pow(F.lit(q), -pos)).over(inside)).alias(f"_local_{y}")
            for y, (b, q) in terms.items()
        ],
    )
    before = Window.partitionBy(*keys).orderBy(block).rangeBetween(-1, -1)
    df = df.select(
        "*",
        *[F.max_by(f"_local_{y}", seq).over(before).alias(f"_carry_{y}") for y in terms],
    )
    return df.withColumns(
        {
            y: F.col(f"_local_{y}")
            + F.coalesce(F.col(f"_carry_{y}") * F.pow(F.lit(q), pos + 1), F.lit(0.0))
            for y, (_, q) in terms.items()
        }
    ).drop(*([] if keep_blocks else [block]), *[f"_{k}_{y}" for y in terms for k in ("local", "carry")])
