"""Cutting a database table into parallel reads."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A source cannot be read as configured."""


@dataclass(frozen=True)
class Split:
    """How to cut a table into parallel reads.

    Either an even stride between two bounds, or explicit ``points`` where the
    keys are not spread evenly: each gap between points is one read, so a range
    that holds a third of the table can be cut as finely as it needs.
    """

    column: str
    lower: int | None = None
    upper: int | None = None
    parts: int | None = None
    points: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        even = (self.lower, self.upper, self.parts)
        rules = {
            "split points must ascend": any(a >= b for a, b in zip(self.points, self.points[1:])),
            "a split needs lower, upper and parts, or points": not self.points and None in even,
            "upper must exceed lower": not self.points and None not in even and self.upper <= self.lower,
            "parts must be at least 1": not self.points and self.parts is not None and self.parts < 1,
        }
        broken = [text for text, is_broken in rules.items() if is_broken]
        if broken:
            raise SourceError(f"{self.column}: {'; '.join(broken)}")

    def boundaries(self) -> tuple[int, ...]:
        """Inner cut points, ascending. n cuts give n + 1 reads."""
        if self.points:
            return self.points
        width = self.upper - self.lower
        parts = min(self.parts, width)
        return tuple(self.lower + width * i // parts for i in range(1, parts))

    def predicates(self) -> list[str]:
        """One WHERE clause per read. Together they cover every row once, NULL included."""
        cuts = self.boundaries()
        if not cuts:
            return ["1 = 1"]
        first = f"{self.column} < {cuts[0]} OR {self.column} IS NULL"
        inner = [f"{self.column} >= {a} AND {self.column} < {b}"
                 for a, b in zip(cuts, cuts[1:])]
        return [first, *inner, f"{self.column} >= {cuts[-1]}"]

    def number(self) -> Column:
        """Index of the read a row belongs to."""
        index = F.lit(0)
        for cut in self.boundaries():
            index = index + F.when(F.col(self.column) >= cut, 1).otherwise(0)
        return index


def points_from(df: DataFrame, column: str, parts: int, accuracy: int = 10_000) -> Split:
    """Cut points that give every read about as many rows, from a quantile sketch of the keys themselves.

    The sketch is merged from those of all tasks and is bounded by ``accuracy``: a read misses its share of
    1 / parts by 1 / accuracy of the rows at most, if no single key is larger. Keys are whole numbers; NULL keys
    are in the first read.
    """
    ranks = [i / parts for i in range(1, parts)] or [0.0]
    cuts, lowest = df.agg(F.percentile_approx(column, ranks, accuracy), F.min(column)).first()
    points = tuple(sorted({int(c) for c in cuts or () if c > lowest}))
    return Split(column, points=points) if points else Split(column, 0, 1, 1)


# What a registry row calls the settings of an even split.
EVEN = {"lower": "lower_bound", "upper": "upper_bound", "parts": "num_partitions"}


def _whole(option: str, text: str) -> int:
    try:
        return int(text)
    except ValueError as error:
        raise SourceError(f"{option} must be an integer, got {text!r}") from error


def split_of(options: Mapping[str, str]) -> Split | None:
    """The split a registry row asks for: a column with points or with all even settings, or none."""
    if not options.get("partition_column"):
        return None
    if points := options.get("split_points"):
        return Split(options["partition_column"],
                     points=tuple(_whole("split_points", p) for p in points.split(",")))
    given = {field: _whole(option, options[option]) for field, option in EVEN.items() if options.get(option)}
    return Split(options["partition_column"], **given)
