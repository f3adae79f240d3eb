"""Delivery conditions as a table function: what becomes of a picture's size and coding on its way."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Condition, longest edge, scale, codec and quality (fixed values).
CONDITIONS = [
    ("none", None, None, None, None),
    ("jpeg90", None, None, "jpeg", 90),
    ("jpeg75", None, None, "jpeg", 75),
    ("jpeg60", None, None, "jpeg", 60),
    ("cms1600", 1600, None, "jpeg", 85),
    ("cms1024", 1024, None, "jpeg", 85),
    ("cms640", 640, None, "jpeg", 80),
    ("webp80", None, None, "webp", 80),
    ("rescale90", None, 0.9, None, None),
    ("sieve_web", 768, None, "jpeg", 60),
    ("sieve_hard", 512, None, "jpeg", 40),
]
_COLUMNS = {"width": IntegerType(), "height": IntegerType(), "codec": StringType(), "quality": IntegerType()}


def delivered(width: int, height: int, longest: int | None, scale: float | None) -> tuple[int, int]:
    """The size after fitting the longer edge or scaling; halves go to the even side, no edge falls under 1."""
    if longest is not None and max(width, height) > longest:
        scale = longest / max(width, height)
    return (width, height) if scale is None else (max(1, round(width * scale)), max(1, round(height * scale)))


class DeliveryConditions:
    """``delivery_conditions(width, height, columns)``: a row for each of the conditions.

    ``columns`` is a constant list of names out of width, height, codec and
    quality, by which the result's columns are told before it runs. A picture
    without a size has nulls for the size.
    """

    def __init__(self, analyzed: AnalyzeResult) -> None:
        self.names = analyzed.schema.fieldNames()[1:]

    @staticmethod
    def analyze(width: AnalyzeArgument, height: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        if not columns.isConstantExpression or not isinstance(columns.value, str):
            raise ValueError("the columns must be a constant text")
        names = [c.strip() for c in columns.value.split(",") if c.strip()]
        if unknown := [c for c in names if c not in _COLUMNS]:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        return AnalyzeResult(schema=StructType([StructField("condition", StringType()), *(StructField(c, _COLUMNS[c]) for c in names)]))

    def eval(self, width: int | None, height: int | None, columns: str) -> Iterator[tuple]:
        for name, longest, scale, codec, quality in CONDITIONS:
            w, h = (None, None) if width is None or height is None else delivered(width, height, longest, scale)
            row = {"width": w, "height": h, "codec": codec, "quality": quality}
            yield (name, *(row[c] for c in self.names))


def register(spark: SparkSession) -> None:
    """Make ``delivery_conditions`` known to SQL of this session."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("delivery_conditions", udtf(DeliveryConditions))
