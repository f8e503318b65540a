"""The few expressions in which Spark SQL and DuckDB differ, so that one statement serves both."""

from __future__ import annotations


class Spark:
    def base(self) -> str:
        return "WITH t AS (SELECT * FROM an_base_trips), k AS (SELECT * FROM an_base_taps)"

    def minutes(self, a: str, b: str) -> str:
        return f"((unix_micros(CAST({b} AS TIMESTAMP)) - unix_micros(CAST({a} AS TIMESTAMP))) / 6e7)"

    def pct(self, x: str, p: float) -> str:
        return f"percentile_approx({x}, {p}, 10000)"  # exact up to 10,000 values of a group

    def rows_of(self, source: str, columns: list[str], values: list[list[str]]) -> str:
        """Each row of the source once per list of values, as further columns: one scan for all of them."""
        flat = ", ".join(v for row in values for v in row)
        return f"{source} LATERAL VIEW stack({len(values)}, {flat}) unpivoted AS {', '.join(columns)}"

    def last_known(self, x: str, over: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({over})"

class DuckDB:
    def base(self) -> str:
        from fareline.plans.transit_sql import BASE

        return BASE

    def minutes(self, a: str, b: str) -> str:
        return f"((epoch_us({b}) - epoch_us({a})) / 6e7)"

    def pct(self, x: str, p: float) -> str:
        return f"quantile_disc({x}, {p})"

    def rows_of(self, source: str, columns: list[str], values: list[list[str]]) -> str:
        structs = ", ".join("{" + ", ".join(f"'{c}': {v}" for c, v in zip(columns, row)) + "}" for row in values)
        return f"(SELECT *, unnest([{structs}], recursive := true) FROM {source}) unpivoted"

    def last_known(self, x: str, over: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

