"""Functions that a session can call from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .operators.segmentation import page_units

_STRINGS = ArrayType(StringType())
_UNITS = (
    StructType().add("unit", "integer").add("char_start", "integer").add("char_end", "integer").add("text", "string")
    .add("headings", _STRINGS).add("captions", _STRINGS).add("salient", "boolean")
)


class PageUnits:
    """page_units(text, headers): the units of a page, without the lines of headers; a null text has none, null headers leave all lines."""

    @staticmethod
    def analyze(text: AnalyzeArgument, headers: AnalyzeArgument) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError(f"page_units: text is a string, not {text.dataType.simpleString()}")
        if not isinstance(headers.dataType, ArrayType) or headers.dataType.elementType != StringType():
            raise ValueError(f"page_units: headers is an array of strings, not {headers.dataType.simpleString()}")
        return AnalyzeResult(schema=_UNITS)

    def eval(self, text: str | None, headers: list[str] | None) -> Iterator[tuple]:
        for k, unit in enumerate(page_units(text or "", set(headers or []))):
            yield k, *(unit[c] for c in _UNITS.names[1:])


def register(spark: SparkSession) -> None:
    """Make the functions of this module known to the session."""
    spark.udtf.register("page_units", udtf(PageUnits))
