"""Statements that read each other: rendered, ordered by what they read, stored where that is asked for.

A project is a set of named SQL texts. A text may name other statements like tables and parameters like
{{least_days}}. Building a result builds what it reads, each once, in an order that follows from the names.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

_PARAMETER = re.compile(r"\{\{(\w+)\}\}")
_WORD = re.compile(r"\w+")


def rendered(text: str, parameters: Mapping[str, object]) -> str:
    """The text with its parameters; a parameter that is not given is a KeyError."""
    return _PARAMETER.sub(lambda m: str(parameters[m[1]]), text)


def band_case(column: str, bands: list[tuple[float | None, str]]) -> str:
    """SQL for the label of the first bound that exceeds the column; null stays null."""
    bounded = "".join(f" WHEN {column} < {high} THEN '{label}'" for high, label in bands if high is not None)
    rest = next((f" WHEN {column} IS NOT NULL THEN '{label}'" for high, label in bands if high is None), "")
    return f"CASE{bounded}{rest} END"


@dataclass
class Project:
    """``stored``: names of results that are written to ``folder`` and read back; others stay views."""

    texts: Mapping[str, str]
    parameters: Mapping[str, object] = field(default_factory=dict)
    stored: Collection[str] = ()
    folder: str = ""

    def reads(self, name: str) -> set[str]:
        return (set(_WORD.findall(self.texts[name])) & set(self.texts)) - {name}

    def order(self, wanted: Collection[str], kept: Collection[str] = ()) -> list[str]:
        """The wanted statements and all they read, each after what it reads. A circle is an error."""
        graph: dict[str, set[str]] = {}
        open_ = list(wanted)
        while open_:
            name = open_.pop()
            if name not in graph:
                graph[name] = set() if name in kept else self.reads(name)
                open_ += graph[name]
        return list(TopologicalSorter(graph).static_order())

    def build(self, spark: SparkSession, wanted: Collection[str], kept: Collection[str] = ()) -> dict[str, DataFrame]:
        """The wanted results by name. ``kept``: results that an earlier build has stored; they are read again
        instead of built, and what only they read is not built either."""
        for name in self.order(wanted, kept):
            path = f"{self.folder}/{name}"
            if name not in kept:
                df = spark.sql(rendered(self.texts[name], self.parameters))
                if name in self.stored:
                    df.write.mode("overwrite").parquet(path)
            result = spark.read.parquet(path) if name in self.stored or name in kept else df
            result.createOrReplaceTempView(name)
        return {name: spark.table(name) for name in wanted}
