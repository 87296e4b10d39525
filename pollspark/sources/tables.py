"""Sources and sinks: parquet bundles with a variant partition, CSV with ``NA``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

NA = "NA"


def variant(model: str, collapse: str, qfilter: str, geog: str | None = None) -> str:
    """Label of a model variant, used as the value of the ``variant`` partition."""
    return "_".join(part for part in (model, collapse, qfilter, geog) if part)


def load_table(
    spark: SparkSession, root: str, name: str, variant: str | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """One directory (or file) per saved object; ``variant`` prunes partitions.

    With a ``schema`` no file is opened before the query runs.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(f"{root}/{name}")
    if variant is None:
        return df
    return df.where(F.col("variant") == variant).drop("variant")


def write_table(df: DataFrame, root: str, name: str, variant: str | None = None) -> None:
    """Save a result; only the partition of ``variant`` is replaced."""
    path = f"{root}/{name}"
    if variant is None:
        df.write.mode("overwrite").parquet(path)
        return
    (
        df.withColumn("variant", F.lit(variant))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("variant")
        .parquet(path)
    )


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV scan with an explicit schema; the text ``NA`` and an empty field are missing in any column."""
    df = spark.read.schema(schema).option("header", header).option("nullValue", NA).csv(path)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text})


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV sink; missing values are printed as ``NA``. One file per partition."""
    df.write.mode("overwrite").option("header", header).option("nullValue", NA).csv(path)
