"""Fixed-width text cells for monospace reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agorametrics import fixed_values as fixed
from agorametrics.functions.numbers import fixed_point


def left_cell(text: Column, width: int) -> Column:
    """Padded on the right, counted in code points; longer text stays whole."""
    return F.when(F.char_length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def right_cell(value: Column, width: int) -> Column:
    """Padded on the left; longer values stay whole."""
    text = value.cast("string")
    return F.when(F.char_length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def name_cell(name: Column) -> Column:
    """Cut to the name column, then padded."""
    return F.rpad(F.left(name, F.lit(fixed.NAME_WIDTH)), fixed.NAME_WIDTH, " ")


def decimal_cell(value: Column, width: int) -> Column:
    return right_cell(fixed_point(value, 2), width)


def line(*cells: Column) -> Column:
    return F.concat_ws(" ", *cells).alias("line")
