"""Dataset sinks: JSON lines as training tools read them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Sink(Protocol):
    def write(self, rows: DataFrame) -> None: ...


def as_json(rows: DataFrame, omit_zero: tuple[str, ...] = ()) -> DataFrame:
    """One column ``value``: each row as JSON without its null fields; maps in the order of their keys.

    ``omit_zero`` names fields that are left out at 0 or empty as well, as readers of older files expect.
    """
    columns = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.MapType):
            c = F.map_from_entries(F.array_sort(F.map_entries(c)))
        if f.name in omit_zero:
            empty = F.size(c) == 0 if isinstance(f.dataType, T.MapType | T.ArrayType) else c == F.lit(0).cast(f.dataType) if isinstance(f.dataType, T.NumericType) else c == ""
            c = F.when(~empty, c)
        columns.append(c.alias(f.name))
    return rows.select(json_of(columns).alias("value"))


def json_of(columns: list[Column]) -> Column:
    """A row's columns as JSON, without the null ones."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


class JsonLines:
    """A folder of JSONL files. ``resume`` adds to an existing one, which must be there; else it must not, or is replaced with ``overwrite``."""

    def __init__(self, path: str, resume: bool = False, omit_zero: tuple[str, ...] = (), overwrite: bool = False) -> None:
        self.path, self.resume, self.omit_zero, self.overwrite = path, resume, omit_zero, overwrite

    def write(self, rows: DataFrame, before: DataFrame | None = None) -> None:
        """``before``: lines that go in as they are."""
        if self.resume:
            rows.sparkSession.read.text(self.path).limit(1).count()  # an error if there is nothing to resume
        lines = as_json(rows, self.omit_zero)
        lines = lines if before is None else before.select("value").union(lines)
        lines.write.mode("append" if self.resume else "overwrite" if self.overwrite else "error").text(self.path)
