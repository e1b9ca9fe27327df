"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import spread

ROWS_PER_SALT = 50_000


def salted_join(many: DataFrame, few: DataFrame, key: str, by: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Inner join where `many` may hold one key very often and each of its rows meets many rows of `few`.

    A key with n rows in `many` is cut into ceil(n / rows_per_salt) parts by a hash of column `by`; the rows of
    `few` for that key are repeated once per part. Ordinary keys have one part and repeat nothing.
    """
    parts = many.groupBy(key).agg(F.ceil(F.count("*") / rows_per_salt).cast("int").alias("_parts"))
    left = many.join(parts, key).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))
    right = few.join(parts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    left, right = spread(left.drop("_parts"), key, "_salt"), spread(right.drop("_parts"), key, "_salt")
    return left.join(right, [key, "_salt"]).drop("_salt")
