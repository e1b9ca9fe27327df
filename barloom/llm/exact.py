"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import documents, fresh, settle, small


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: Sequence[str] | None = None,
    prefix: int = 64,
    row_id: str | None = None,
) -> DataFrame:
    """The rows of `docs` (columns `carry`, by default all) with keep_id, group_size and kept.

    Texts are equal when identical; null counts as empty. The row with the largest id of a group stays; of rows that
    also share the id, exactly one. A null id loses against any other. Existing columns named keep_id, group_size or
    kept are replaced. An empty table gives an empty one.

    Rows are first grouped by byte length; those with company by a hash of their first characters; only the texts that
    still have company are hashed whole. Every grouping is a count with partial aggregation, so that a group with a
    third of all rows is a row per task; a row with no company joins under a key of its own. `row_id` names a column that
    tells rows apart and is the same in every scan; without one, rows are numbered once and written with `carry`.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("keep_id", "group_size", "kept")]
    rid, size, head, whole, found, best, total = fresh(docs.columns, "rid", "size", "head", "whole", "found", "best", "total")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({rid: F.col(row_id) if row_id else F.monotonically_increasing_id(), size: F.octet_length(content)})

    lengths = small(rows.groupBy(size).count().filter("count > 1").select(size))
    rows = rows.withColumn(head, F.xxhash64(F.substring(content, 1, prefix)))
    heads = rows.select(size, head).join(lengths, size)
    survivors = small(heads.groupBy(size, head).count().filter("count > 1").select(size, head, F.lit(True).alias(found)))

    hashed = rows.join(survivors, [size, head], "left")
    hashed = hashed.withColumn(whole, F.when(F.col(found), F.sha2(content, 256)).otherwise(F.concat(F.lit("#"), F.to_json(F.struct(rid)))))
    (own,) = fresh([*docs.columns, rid, size, head, whole, found, best, total], "own")
    hashed = hashed.select(*carry, F.col(doc_id).alias(own), rid, whole, found)
    hashed = hashed if row_id else settle(hashed)
    groups = (
        hashed.filter(found)
        .groupBy(whole)
        .agg(F.count("*").alias(total), F.max(F.struct(F.col(own).alias("id"), F.col(rid).alias("row"))).alias(best))
        .filter(F.col(total) > 1)
    )
    joined = hashed.join(small(groups), whole, "left")  # written first: a hot group's side of a shuffled join can be split
    return joined.select(
        *carry,
        F.when(F.col(total).isNull(), F.col(own)).otherwise(F.col(f"{best}.id")).alias("keep_id"),
        F.coalesce(F.col(total), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col(f"{best}.row") == F.col(rid), F.lit(True)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = exact_dedup(docs, carry=["doc_id", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS content FROM documents),
g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY content)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.content) AS text_sha256
FROM t JOIN g USING (content)
"""
