"""Separation of rows that fail to parse, with an error-recovering grammar for quoted records.

    file   := record (break record)*
    record := field ("," field)*
    field  := quoted | bare
    quoted := '"' (any character but '"' | '""')* '"'
    bare   := (any character but '"', ',' and line breaks)*

Each rule is one method of ``Grammar``. A field that is neither quoted nor bare is a located error; the
parser then resumes at the next line break that is followed by a validated record start: a first field of
the table's form, with the table's number of well-formed fields up to the next break. Without one, the rest
belongs to the broken record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """Columns of a table, the form of its first field, and tests of single columns."""

    columns: tuple[str, ...]
    anchor: str
    tests: dict[str, Callable[[str], bool]] = field(default_factory=dict)


@dataclass
class Record:
    values: list[str]
    begin: int
    #: (offset, reason) of the first syntax error, if any.
    error: tuple[int, str] | None = None


_DECIMAL = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?")
_INTEGER = re.compile(r"[+-]?[0-9]+")
_MOMENT = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}")


def is_decimal(text: str) -> bool:
    return _DECIMAL.fullmatch(text) is not None


def is_int32(text: str) -> bool:
    if _INTEGER.fullmatch(text) is None:
        return False
    digits = text.lstrip("+-").lstrip("0") or "0"
    return len(digits) <= 10 and -(2**31) <= (-int(digits) if text[0] == "-" else int(digits)) < 2**31


def is_moment(text: str) -> bool:
    if _MOMENT.fullmatch(text) is None:
        return False
    try:
        datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return False
    return int(text[17:]) < 60


class Grammar:
    """Recursive descent over one text; ``width`` and ``anchor`` validate a record start."""

    def __init__(self, text: str, width: int, anchor: re.Pattern[str]):
        self.text, self.width, self.anchor, self.at, self.field_at = text, width, anchor, 0, 0
        self.error: tuple[int, str] | None = None

    def file(self) -> list[Record]:
        records = [self.record()]
        while self.at < len(self.text):
            self.skip_break()
            records.append(self.record())
        return records

    def record(self) -> Record:
        begin, self.error = self.at, None
        values = [self.field()]
        while self.error is None and self.at < len(self.text) and self.text[self.at] == ",":
            self.at += 1
            values.append(self.field())
        if self.error is not None:
            self.resume()
        return Record(values, begin, self.error)

    def field(self) -> str:
        self.field_at = self.at
        return self.quoted() if self.text.startswith('"', self.at) else self.bare()

    def quoted(self) -> str:
        text, begin = self.text, self.at
        close = text.find('"', begin + 1)
        while close >= 0 and text.startswith('"', close + 1):
            close = text.find('"', close + 2)
        if close < 0:
            return self.fail(begin, "quote not closed")
        self.at = close + 1
        if self.at < len(text) and text[self.at] not in ",\r\n":
            return self.fail(self.at, "text after a closing quote")
        return text[begin + 1 : close].replace('""', '"')

    def bare(self) -> str:
        begin = self.at
        self.at = _BARE.match(self.text, begin).end()
        if self.text.startswith('"', self.at):
            return self.fail(self.at, "quote inside a field")
        return self.text[begin : self.at]

    def fail(self, at: int, reason: str) -> str:
        self.error = (at, reason)
        return ""

    def skip_break(self) -> None:
        self.at += 2 if self.text.startswith("\r\n", self.at) else 1

    def resume(self) -> None:
        """To the first break in or after the broken field before a validated record start, else the end.

        A quote that is not meant to open swallows records up to the next one, so the search begins at the
        field and not where the error showed.
        """
        for found in _BREAK.finditer(self.text, self.field_at):
            if self.anchor.match(self.text, found.end()) and self.is_record(found.end()):
                self.at = found.start()
                return
        self.at = len(self.text)

    def is_record(self, at: int) -> bool:
        ahead = Grammar(self.text, self.width, self.anchor)
        ahead.at = at
        n = 1
        ahead.field()
        while ahead.error is None and ahead.at < len(self.text) and self.text[ahead.at] == "," and n <= self.width:
            ahead.at += 1
            ahead.field()
            n += 1
        return ahead.error is None and n == self.width


_BARE = re.compile(r'[^",\r\n]*')
_BREAK = re.compile(r"\r\n|\r|\n")


def parse(text: str | None, contract: Contract, anchor: re.Pattern[str] | None = None) -> list[Record]:
    """The records of a text, with located errors; each of them typed only after ``verdict``."""
    return Grammar(text or "", len(contract.columns), anchor or re.compile(contract.anchor)).file()


def verdict(record: Record, contract: Contract) -> tuple[str, str, int] | None:
    """(reason, detail, offset) for the first of quoting, columns and value that a record fails."""
    if record.error:
        return "quoting", record.error[1], record.error[0]
    if len(record.values) != len(contract.columns):
        return "columns", f"{len(record.values)} fields instead of {len(contract.columns)}", record.begin
    for name, value in zip(contract.columns, record.values):
        if name in contract.tests and value and not contract.tests[name](value):
            return "value", f"{name}: {value[:80]}", record.begin
    return None


def line_verdict(text: str | None, contract: Contract, anchor: re.Pattern[str]) -> tuple[tuple[str, str, int] | None, list[str] | None]:
    """Verdict on a text that should hold exactly one record, and the record's values if it does.

    A line break outside quotes does not end such a record; it belongs to the field around it.
    """
    records = parse(text, contract, anchor)
    broken = next((r for r in records if r.error), None)
    if broken:
        return verdict(broken, contract), None
    whole = records[0]
    for r in records[1:]:
        at = r.begin - (2 if text.startswith("\r\n", r.begin - 2) else 1)
        if text.endswith('"', 0, at) or text.startswith('"', r.begin):
            return ("quoting", "text beside a quoted field", at), None
        whole = Record([*whole.values[:-1], whole.values[-1] + text[at : r.begin] + r.values[0], *r.values[1:]], whole.begin)
    found = verdict(whole, contract)
    return found, None if found else whole.values


RESULT = "table_name string, reason string, detail string, error_at int, values array<string>"


def parse_lines(lines: DataFrame, contracts: dict[str, Contract], key: str, table: str = "table_name", line: str = "raw_line") -> DataFrame:
    """One row per line: ``key``, table_name, reason, detail, error_at (offset) and, without a reason, the values.

    A null line is an empty one. A line of a table without a contract gets the reason 'table'. Stateless and
    narrow: no shuffle, batches of Arrow, so lines of any number and skew are read in equal shares. An empty
    value stays '' here; ``typed`` makes it null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = {name: re.compile(c.anchor) for name, c in contracts.items()}
        for batch in batches:
            names, reasons, details, places, values = [], [], [], [], []
            for name, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if name in contracts:
                    wrong, found = line_verdict(text, contracts[name], anchors[name])
                else:
                    wrong, found = ("table", "no contract", 0), None
                names.append(name)
                reasons.append(wrong and wrong[0])
                details.append(wrong and wrong[1])
                places.append(wrong and wrong[2])
                values.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in ((names, pa.string()), (reasons, pa.string()), (details, pa.string()), (places, pa.int32()), (values, pa.list_(pa.string()))))],
                names=["__key", "table_name", "reason", "detail", "error_at", "values"],
            )

    kind = lines.schema[key].dataType.simpleString()
    return lines.select(F.col(key).alias("__key"), F.col(table).cast("string").alias("t"), F.col(line).cast("string").alias("l")).mapInArrow(run, f"__key {kind}, {RESULT}").withColumnRenamed("__key", key)


RECORDS = "table_name string, record_no int, begin int, reason string, detail string, error_at int, values array<string>"


def parse_texts(texts: DataFrame, contracts: dict[str, Contract], key: str, table: str = "table_name", text: str = "text") -> DataFrame:
    """One row per record of texts that hold many: ``key``, table_name, record_no (from 0), begin (offset), reason,
    detail, error_at and, without a reason, the values.

    A record that breaks the grammar ends where the next validated record start is, so one stray quote does not
    take the records after it along. Null and empty texts have no record; blank lines are none. A text is parsed
    by one task: callers cut larger files into blocks. A table without a contract is one record with the reason 'table'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = {name: re.compile(c.anchor) for name, c in contracts.items()}
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
        names = ["__key", *(f.split()[0] for f in RECORDS.split(", "))]
        for batch in batches:
            at, rows = [], []
            for i, (name, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not body:
                    continue
                records = parse(body, contracts[name], anchors[name]) if name in contracts else [Record([], 0, (0, "no contract"))]
                records = [r for r in records if r.error or r.values != [""]]
                for n, r in enumerate(records):
                    wrong = verdict(r, contracts[name]) if name in contracts else ("table", "no contract", 0)
                    at.append(i)
                    rows.append((name, n, r.begin, *(wrong or (None, None, None)), None if wrong else r.values))
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    kind = texts.schema[key].dataType.simpleString()
    picked = texts.select(F.col(key).alias("__key"), F.col(table).cast("string").alias("t"), F.col(text).cast("string").alias("l"))
    return picked.mapInArrow(run, f"__key {kind}, {RECORDS}").withColumnRenamed("__key", key)


def typed(parsed: DataFrame, contract: Contract, table: str, key: str, types: Sequence[str]) -> DataFrame:
    """The valid rows of one table as typed columns; '' is null. Values that no test covers and that do not
    fit their type are null as well."""
    rows = parsed.where((F.col("table_name") == table) & F.col("reason").isNull())
    return rows.select(key, *[F.nullif(F.get("values", F.lit(i)), F.lit("")).try_cast(t).alias(c) for i, (c, t) in enumerate(zip(contract.columns, types))])


def split_failed(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())
