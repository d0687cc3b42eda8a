"""Short literal tables that the planner knows the size of."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def literal_table(spark: SparkSession, rows, schema: str | StructType) -> DataFrame:
    """A DataFrame of a few rows, handed over as one Arrow table."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrow = to_arrow_schema(fields)
    table = pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)],
                                 schema=arrow)
    return spark.createDataFrame(table, schema=fields)


def filled(text: str, *values: Column) -> Column:
    """A text with columns in the places {0}, {1}, …; null when one of them is null."""
    parts = [values[int(p)].cast("string") if i % 2 else F.lit(p)
             for i, p in enumerate(re.split(r"\{(\d)\}", text)) if i % 2 or p]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
