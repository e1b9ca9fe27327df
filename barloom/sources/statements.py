"""Holdings statements as rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import spread

FIELD = r',("(?:[^"]|"")*"|[^,]*)'


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; quoted cells may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), 1)
    quoted = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), quoted(x)).otherwise(x))


def rows_of(documents: DataFrame, by=("file",)) -> DataFrame:
    """(file, text) -> (file, row, cells); blank lines do not count as rows."""
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    # Parsing is CPU work on few bytes; header look-up and lots reuse this partitioning.
    df = spread(documents, *by).select(*by, F.posexplode(lines).alias("row", "line"))
    return df.select(*by, "row", csv_cells(F.col("line")).alias("cells"))


def scan_statements(spark: SparkSession, path: str) -> DataFrame:
    """Every statement file under `path` as (file, text). A statement is one account's document, read whole."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
