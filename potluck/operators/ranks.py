"""Numbering rows in a global order without bringing them into one partition (WIN6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.sources.shared import fresh_path


def with_id(df: DataFrame) -> DataFrame:
    """df with a column id: as it is if it has one, else written to the shared folder with one, so that it stays the same."""
    if "id" in df.columns:
        return df
    path = fresh_path(df.sparkSession, "rows")
    df.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, *order: Column | str, name: str = "number", key: str = "id") -> DataFrame:
    """df with a column of the numbers 1, 2, 3 ... in the given order, which must tell apart all rows but equal ones; key tells apart all rows.

    Only the key and what the order needs are moved: they are placed by range and sorted within their
    partitions; a row's number is its place there plus the sizes of the partitions before, of which the
    driver holds one number each. The places are written to the shared folder, as a second sampling of the
    ranges could place rows otherwise; then df gets them by its key.
    """
    spark = df.sparkSession
    place = F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    path = fresh_path(spark, "places")
    # the plan keeps no other column below the projection, so wide rows stay where they are
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(key).alias("__key"), place.alias("__place")).write.parquet(path)
    placed = spark.read.parquet(path)
    offset, offsets = 0, {}
    for part, n in sorted(tuple(r) for r in placed.groupBy("__place.part").count().collect()):
        offsets[part], offset = offset, offset + n
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else F.create_map().cast("map<int,int>")
    numbers = placed.select(F.col("__key"), (F.element_at(table, F.col("__place.part")) + F.col("__place.at") + 1).cast("long").alias(name))
    return df.join(numbers, df[key] == numbers["__key"]).drop("__key")
