"""Contracts of numbers and lists that judges return: a value, or null if it breaks the contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonnegative_int(x: Column) -> Column:
    v = x.try_cast("double")
    return F.when((v >= 0) & (v == F.floor(v)), v.cast("bigint"))


def nonnegative_number(x: Column) -> Column:
    v = x.try_cast("double")
    return F.when((v >= 0) & ~F.isnan(v), v)


def binary(x: Column) -> Column:
    v = x.try_cast("double")
    return F.when(v.isin(0.0, 1.0), v.cast("int"))


def _all_of(values: Column, allowed: tuple[float, ...], expected: Column | None) -> Column:
    good = F.forall(values, lambda x: F.coalesce(x.isin(*allowed), F.lit(False)))
    return F.when(good & (F.size(values) == expected if expected is not None else F.lit(True)), values)


def int_list(values: Column, expected: Column | None = None) -> Column:
    good = F.forall(values, lambda x: F.coalesce((x >= 0) & (x == F.floor(x)), F.lit(False)))
    return F.when(good & (F.size(values) == expected if expected is not None else F.lit(True)), values)


def binary_list(values: Column, expected: Column | None = None) -> Column:
    return _all_of(values, (0.0, 1.0), expected)


def ternary_list(values: Column, expected: Column | None = None) -> Column:
    return _all_of(values, (-1.0, 0.0, 1.0), expected)


def directionality_list(values: Column, expected: Column | None = None) -> Column:
    return _all_of(values, (0.0, 0.5, 1.0), expected)


def string_list(values: Column) -> Column:
    good = F.forall(values, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return F.when((F.size(values) > 0) & good, F.transform(values, lambda x: F.trim(x)))


def satisfies(values: Column, contract: Column, expected: Column) -> Column:
    """Does a list of numbers keep the named contract; an unknown contract is null, not false."""
    return (
        F.when(contract == "int_list", int_list(values, expected).isNotNull()).when(contract == "binary_list", binary_list(values, expected).isNotNull())
        .when(contract == "ternary_list", ternary_list(values, expected).isNotNull()).when(contract == "directionality_list", directionality_list(values, expected).isNotNull())
    )
