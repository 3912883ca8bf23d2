"""Windowing as a table function of SQL.

    register(spark)
    SELECT * FROM fixed_windows(TABLE(samples), by => 'channel', order => 'ts,id', value => 'v', width => 256)

gives, for each value of ``by``, its values in order in windows of ``width``; a last
window that isn't full is left out.  Spark deals and sorts the rows, as ``analyze``
asks; a window's values are all that a task holds.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class FixedWindows:
    def __init__(self) -> None:
        self.values: list = []
        self.number = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, by: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument, width: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        if width.value is None or width.value < 1:
            raise ValueError("width must be at least 1")
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        asked = [by.value, value.value, *order.value.split(",")]
        if unknown := [c for c in asked if c not in kinds]:
            raise ValueError(f"no such columns: {unknown}")
        schema = StructType([StructField(by.value, kinds[by.value]), StructField("win_idx", LongType()), StructField("values", ArrayType(kinds[value.value]))])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn(c) for c in order.value.split(",")])

    def eval(self, table, by, order, value, width):
        self.values.append(table[value])
        if len(self.values) == width:
            yield table[by], self.number, self.values
            self.values, self.number = [], self.number + 1

    def terminate(self):
        """What is left doesn't fill a window."""
        return iter(())


def register(spark: SparkSession) -> None:
    spark.udtf.register("fixed_windows", udtf(FixedWindows))
