"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from typing import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from spanloom.session import configure, write_and_read

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A null id counts as the largest one wherever the smallest id of a group is looked for.
NULL_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: it cuts the lineage and outlives executors."""
    return write_and_read(df, name)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other letters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def per_row(df: DataFrame, keep: list[str], text: str, fields: list[StructField],
            f: Callable[[Iterable[str]], Iterator[tuple]]) -> DataFrame:
    """Columns ``keep`` and, for each text, the values that ``f`` yields for it.

    ``f`` gets the texts of one Arrow batch (None for null) and yields one tuple
    per text, in order. Only ``keep`` and ``text`` cross to Python.
    """
    schema = StructType([df.schema[c] for c in keep] + fields)
    names = [x.name for x in fields]
    types = _arrow_types(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            columns = list(zip(*f(x.as_py() for x in texts))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [pa.array(c, type=t) for c, t in zip(columns, types)], keep + names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _arrow_types(fields: list[StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(x.dataType) for x in fields]
