"""An immutable, fluent query over one table of a snapshot and the tables joined to it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like_ascii(column: Column, pattern: str) -> Column:
    """LIKE that takes A-Z and a-z as equal, other letters and the backslash as they are."""
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lowered = "".join(c.lower() if c.isascii() else c for c in pattern).replace("\\", "\\\\")
    return fold(column.cast("string")).like(lowered)


@dataclass(frozen=True)
class Query:
    """Every method gives a new query. Conditions are joined by AND and follow SQL's three-valued logic; joins
    are inner equi-joins whose left side is always the first table (a star)."""

    snapshot: Any
    name: str
    conditions: tuple[Column, ...] = ()
    joins: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = ()
    columns: tuple[str, ...] = ()
    order: tuple[str, bool] | None = None
    top: int | None = None

    def _with(self, condition: Column) -> Query:
        return replace(self, conditions=(*self.conditions, condition))

    def having(self, other: DataFrame, on: dict[str, str], without: bool = False) -> Query:
        """Rows for which other has a row with equal values in the pairs of columns `on` (without: has none): a semi or anti join, before the joins of the query."""
        held = other.select(*(F.col(b).alias(f"_on{i}") for i, b in enumerate(on.values())))
        rows = self.snapshot.frame(self.name)
        same = [rows[a] == held[f"_on{i}"] for i, a in enumerate(on)]
        return replace(self, snapshot=self.snapshot.replace(**{self.name: rows.join(held, same, "left_anti" if without else "left_semi")}))

    def select(self, *columns: str) -> Query:
        """SQL expressions; none: all columns."""
        return replace(self, columns=columns)

    def eq(self, c: str, v) -> Query:
        return self._with(F.expr(c) == F.lit(v))

    def eq_null_safe(self, c: str, v) -> Query:
        return self._with(F.expr(c).eqNullSafe(F.lit(v)))

    def neq(self, c: str, v) -> Query:
        return self._with(F.expr(c) != F.lit(v))

    def gt(self, c: str, v) -> Query:
        return self._with(F.expr(c) > F.lit(v))

    def gte(self, c: str, v) -> Query:
        return self._with(F.expr(c) >= F.lit(v))

    def lt(self, c: str, v) -> Query:
        return self._with(F.expr(c) < F.lit(v))

    def lte(self, c: str, v) -> Query:
        return self._with(F.expr(c) <= F.lit(v))

    def in_(self, c: str, values) -> Query:
        """Of no values: never true."""
        return self._with(F.expr(c).isin(list(values)) if len(values) else F.lit(False))

    def not_in(self, c: str, values) -> Query:
        """Of no values: true, for null as well."""
        return self._with(~F.expr(c).isin(list(values)) if len(values) else F.lit(True))

    def is_null(self, c: str) -> Query:
        return self._with(F.expr(c).isNull())

    def not_null(self, c: str) -> Query:
        return self._with(F.expr(c).isNotNull())

    def ilike(self, c: str, pattern: str) -> Query:
        return self._with(like_ascii(F.expr(c), pattern))

    def where(self, conditions: dict | None = None, **more) -> Query:
        """Equality with each value; None asks for null."""
        out = self
        for c, v in {**(conditions or {}), **more}.items():
            out = out.is_null(c) if v is None else out.eq(c, v)
        return out

    def join(self, other: str, on: dict[str, str]) -> Query:
        """on: columns of the first table to columns of the other."""
        return replace(self, joins=(*self.joins, (other, tuple(on.items()))))

    def sort(self, c: str, desc: bool = False) -> Query:
        """The last sort holds; nulls come first, or last if descending."""
        return replace(self, order=(c, desc))

    def limit(self, n: int) -> Query:
        return replace(self, top=n)

    def _rows(self) -> DataFrame:
        out = self.snapshot.frame(self.name)
        base = {c: F.col(f"{self.name}.{c}") for c in out.columns}
        out = out.alias(self.name)
        for other, pairs in self.joins:
            right = self.snapshot.frame(other).alias(other)
            condition = F.lit(True)
            for left_c, right_c in pairs:
                condition = condition & (base[left_c] == F.col(f"{other}.{right_c}"))
            out = out.join(right, condition)
        for condition in self.conditions:
            out = out.where(condition)
        return out

    def df(self) -> DataFrame:
        out = self._rows()
        if self.order:
            c, desc = self.order
            out = out.orderBy(F.expr(c).desc_nulls_last() if desc else F.expr(c).asc_nulls_first())
        if self.columns:
            out = out.selectExpr(*self.columns)
        return out if self.top is None else out.limit(self.top)

    def count_df(self) -> DataFrame:
        """n: the number of rows without the limit."""
        return self._rows().agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.count_df().first()["n"]

    def all(self, most: int = 100_000) -> list[dict]:
        """The rows, for results of at most `most`; larger ones are an error, not a cut."""
        rows = self.df().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows: use df()")
        return [dict(zip(r.__fields__, r)) for r in rows]

    def first(self) -> dict | None:
        rows = self.df().limit(1).collect()
        return dict(zip(rows[0].__fields__, rows[0])) if rows else None

    def explain(self) -> str:
        return self.df()._jdf.queryExecution().toString()

    def assert_exists(self) -> Query:
        if self.first() is None:
            raise AssertionError(f"no row of {self.name} matches")
        return self

    def assert_none(self) -> Query:
        if (row := self.first()) is not None:
            raise AssertionError(f"a row of {self.name} matches: {row}")
        return self

    def assert_eq(self, c: str, value) -> Query:
        row = self.first()
        if row is None or row.get(c) != value:
            raise AssertionError(f"{self.name}.{c} is {row and row.get(c)!r}, not {value!r}")
        return self

    def assert_count(self, eq: int | None = None, least: int | None = None, most: int | None = None) -> Query:
        n = self.count()
        if (eq is not None and n != eq) or (least is not None and n < least) or (most is not None and n > most):
            raise AssertionError(f"{n} rows of {self.name} match")
        return self


def projected(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in that order; one that rows doesn't have is null."""
    return rows.select(*(F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names))
