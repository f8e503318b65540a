"""Filtered, sorted and paged reads of a table, from text parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BadRequest(ValueError):
    """A filter or sort column that the table does not offer."""


@dataclass(frozen=True)
class View:
    """What may be asked of a table. either: a filter name that matches any of several columns."""

    equal: Sequence[str]
    day: str | None = None
    either: dict[str, Sequence[str]] | None = None
    search: Sequence[str] = ()
    sortable: Sequence[str] = ()
    tiebreak: Sequence[str] = ()


def filtered(df: DataFrame, view: View, filters: dict[str, str]) -> DataFrame:
    for name, value in filters.items():
        if name in view.equal:
            df = df.where(F.col(name).cast("string") == value)
        elif view.either and name in view.either:
            test: Column = F.lit(False)
            for column in view.either[name]:
                test = test | (F.col(column).cast("string") == value)
            df = df.where(test)
        elif view.day and name == "from":
            df = df.where(F.col(view.day).cast("date") >= F.lit(value).cast("date"))
        elif view.day and name == "to":
            df = df.where(F.col(view.day).cast("date") <= F.lit(value).cast("date"))
        elif view.search and name == "q":
            test = F.lit(False)
            for column in view.search:
                test = test | F.contains(F.lower(F.col(column)), F.lit(value.lower()))
            df = df.where(test)
        else:
            raise BadRequest(f"unknown filter {name}")
    return df


def ordered(df: DataFrame, view: View, sort: str) -> DataFrame:
    """sort: column names joined by ','; '-' before one sorts it downwards. Nulls come last."""
    order = []
    for part in filter(None, sort.split(",")):
        name = part.lstrip("-")
        if name not in view.sortable:
            raise BadRequest(f"unknown sort column {name}")
        order.append(F.desc_nulls_last(name) if part.startswith("-") else F.asc_nulls_last(name))
    return df.orderBy(*order, *[F.asc_nulls_last(c) for c in view.tiebreak])


def page(df: DataFrame, view: View, filters: dict[str, str], sort: str, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """The rows of a page, and how many rows there are in all."""
    found = filtered(df, view, filters)
    return ordered(found, view, sort).offset(offset).limit(limit), found.count()
