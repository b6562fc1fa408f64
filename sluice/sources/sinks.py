"""Writers of hits and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that the reduced projection drops.
INTERNAL = ["ord", "rule_ord", "col_start", "col_end", "index_start", "index_end", "need_keyvalue", "entropy", "is_mechanical", "match"]


def append_json_lines(df: DataFrame, path: str) -> None:
    """[K1]"""
    df.write.mode("append").json(path)


def json_array(df: DataFrame, path: str) -> None:
    """One JSON document for a result that is small by nature (a report). [K2]"""
    df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def checkpoint_table(df: DataFrame, path: str) -> None:
    """A stage's output as Parquet. [K3, K8]"""
    df.write.mode("overwrite").parquet(path)


def unscanned(assets: DataFrame, scanned: DataFrame) -> DataFrame:
    """Assets that no earlier run has scanned. [K4]"""
    return assets.join(scanned.select("file").distinct(), "file", "left_anti")


def reduced(df: DataFrame) -> DataFrame:
    """[K5]"""
    return df.drop(*INTERNAL)


def split_jwt(df: DataFrame) -> DataFrame:
    """``df`` with bucket jwt or others, for ``partitionBy``. [K6]"""
    return df.withColumn("bucket", F.when((F.col("rule_name") == "jwt") | F.contains("value", F.lit("eyJh")), "jwt").otherwise("others"))


def collision_names(df: DataFrame, name_col: str = "name") -> DataFrame:
    """``df`` with names made unique by a ``_vN`` suffix, in url order. [K8]"""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(name_col).orderBy("url")) - 1
    stem, ext = F.regexp_replace(name_col, r"\.[^.]*$", ""), F.regexp_extract(name_col, r"(\.[^.]*)$", 1)
    return df.withColumn("__k", k).withColumn("stored_as", F.when(F.col("__k") == 0, F.col(name_col)).otherwise(F.concat(stem, F.lit("_v"), F.col("__k").cast("string"), ext))).drop("__k")
