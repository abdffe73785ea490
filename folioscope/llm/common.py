"""What several operators share: tables in the shared folder, hold-out marks, vocabulary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept as materialise
from ..session import shared_dir, ship

__all__ = ["A_TO_Z", "ascii_lower", "drop_table", "held_out", "materialise", "pages_of", "shared_dir", "text_rows"]

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, unlike ``lower``, which changes other letters and even lengths."""
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def drop_table(df: DataFrame) -> None:
    """Deletes the files below a table made by ``materialise`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the identifier's decimal text is divisible by 5; a null identifier is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pages_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """Identifier and text alone, so that extra columns, whatever their names, play no part."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
