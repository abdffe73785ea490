"""Plain text as documents: each line that isn't blank is a paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model


def paragraphs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks (uri from ``key``) of the lines of ``text``; a null text has none."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    out = rows.select(F.col(key).cast("string").alias("uri"), F.posexplode(lines).alias("pos", "text"))
    return model.complete(out.withColumn("id", F.concat(F.lit("b"), (F.col("pos") + 1).cast("string"))).withColumn("kind", F.lit("paragraph")), model.BLOCKS)
