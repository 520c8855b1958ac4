"""Decoding and formatting of the text fields of a concept data set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_whole_number(c: Column) -> Column:
    return c.rlike(r"^-?\d+$")


def typed_long(c: Column) -> Column:
    """The whole number a text holds, else null."""
    return F.when(is_whole_number(c), c.try_cast("long"))


def typed_double(c: Column) -> Column:
    """The number a text holds, whole or not, else null."""
    return F.when(c.rlike(r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def drop_empty(c: Column) -> Column:
    """Items of a ``;``-separated list, empty ones dropped."""
    return F.filter(F.split(c, ";"), lambda s: s != "")


def label_map(c: Column) -> Column:
    """``"object(4546); part(452)"`` as a map from category to count."""

    def entry(item: Column) -> Column:
        item = F.trim(item)
        number = F.rtrim(F.substring_index(item, "(", -1), F.lit(")"))
        return F.struct(F.substring_index(item, "(", 1).alias("key"), number.try_cast("int").alias("value"))

    return F.map_from_entries(F.transform(drop_empty(c), entry))


def class_name(line: Column) -> Column:
    """``"/b/beach/indoor 12"`` to ``beach/indoor``: up to two parts after the letter."""
    parts = F.split(F.element_at(F.split(line, " "), 1), "/")
    return F.array_join(F.slice(parts, 3, 2), "/")


def display_name(c: Column) -> Column:
    """Drop a trailing ``-s`` or ``-c`` and show underscores as blanks."""
    # fixed by the data: scenes end in -s, colours in -c
    marked = c.endswith("-s") | c.endswith("-c")
    return F.translate(F.when(marked, F.substring(c, F.lit(1), F.length(c) - 2)).otherwise(c), "_", " ")


def two_decimals(value: Column) -> Column:
    """Two decimals of the exact binary value; exact halves go to the even hundredth.

    From 0 to below 8 the value times 2**60 is a whole number (what is smaller than 2**-8
    shows as 0.00 anyway), so hundredths are counted in whole numbers.
    """
    unit = F.lit(1 << 60).cast("decimal(38,0)")
    parts = (value * F.lit(float(1 << 60))).cast("long").cast("decimal(20,0)") * 100
    low = ((parts - parts % unit) / unit).cast("long")
    twice = (parts % unit) * 2
    up = (twice > unit) | ((twice == unit) & (low % 2 == 1))
    cents = low + F.when(up, 1).otherwise(0)
    exact = F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), (cents % 100).cast("long"))
    return F.when((value >= 0) & (value < 8), exact).otherwise(F.format_string("%.2f", value))


def location_name(file: Column, rate: Column, label: Column, unit: Column) -> Column:
    """``<file without its four-character suffix>_<rate, two decimals>_<label>_<unit>``.

    The rate is rounded as the exact number that the double stands for.
    """
    stem = F.substring(file, F.lit(1), F.length(file) - 4)
    shown = two_decimals(rate)
    return F.concat_ws("_", stem, shown, label, unit.cast("string"))
