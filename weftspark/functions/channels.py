"""Texel arithmetic on 8-bit samples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division."""
    return F.call_function("div", a.cast("bigint"), (b if isinstance(b, Column) else F.lit(b)).cast("bigint"))


def shifted_left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value.cast("bigint"), bits.cast("int"))


def shifted_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value.cast("bigint"), bits.cast("int"))


def inverted(v: Column) -> Column:
    return (F.lit(255) - v).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.709 weights in ten-thousandths, rounded down."""
    return div(r * 2126 + g * 7152 + b * 722, 10000).cast("int")


def override_alpha(a: Column, mode: str) -> Column:
    return {"black": F.lit(0), "white": F.lit(255)}.get(mode, a).cast("int")


def fill_alpha(mode: str) -> Column:
    """In merging, any mode but white is black."""
    return F.lit(255 if mode == "white" else 0)


def mip_size(base: Column, level: Column) -> Column:
    return F.greatest(F.lit(1), shifted_right(base, level)).cast("int")


def bc3_size(width: Column, height: Column) -> Column:
    return div(width + 3, 4) * div(height + 3, 4) * 16
