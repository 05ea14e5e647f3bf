"""Filters as composable Column predicates; the optimizer pushes them to the scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(predicates) -> Column:
    """OR; no predicate lets everything pass."""
    predicates = list(predicates)
    return reduce(lambda a, b: a | b, predicates) if predicates else F.lit(True)


def all_of(predicates) -> Column:
    """AND; no predicate lets everything pass."""
    predicates = list(predicates)
    return reduce(lambda a, b: a & b, predicates) if predicates else F.lit(True)


def contains_any(column: str, words: list[str] | None) -> Column:
    """Case-insensitive substring of any word. ``%`` and ``_`` keep their meaning as wildcards; no words: no filter."""
    return any_of(F.col(column).ilike(f"%{w}%") for w in words or [])


def like_any(column: str, patterns: list[str] | None) -> Column:
    """``ILIKE ANY``; a missing list is bypassed, an empty one lets nothing pass."""
    if patterns is None:
        return F.lit(True)
    return any_of(F.col(column).ilike(p) for p in patterns) if patterns else F.lit(False)


def active(column: str, keep_unknown: bool) -> Column:
    """Not flagged. Of unknown flags (a left join that found nothing) ``NOT x`` drops, ``x IS NOT TRUE`` keeps the row."""
    return F.coalesce(~F.col(column), F.lit(keep_unknown))


def longer_than(column: str, n: int) -> Column:
    return F.length(column) > n


@dataclass(frozen=True)
class Box:
    """A bounding box that is checked when it is made."""

    west: float
    south: float
    east: float
    north: float

    @staticmethod
    def parse(text: str, limits: tuple[float, float, float, float] = (-180, -90, 180, 90)) -> Box:
        parts = text.split(",")
        if len(parts) != 4:
            raise ValueError("a box has four numbers: west,south,east,north")
        box = Box(*map(float, parts))
        if not (limits[0] <= box.west < box.east <= limits[2] and limits[1] <= box.south < box.north <= limits[3]):
            raise ValueError(f"not a box within {limits}: {text}")
        return box

    def holds(self, x: str, y: str) -> Column:
        return F.col(x).between(self.west, self.east) & F.col(y).between(self.south, self.north)

    def overlaps(self, min_x: str, min_y: str, max_x: str, max_y: str) -> Column:
        return (F.col(min_x) <= self.east) & (F.col(max_x) >= self.west) & (F.col(min_y) <= self.north) & (F.col(max_y) >= self.south)


@dataclass
class Filters:
    """What a search form holds: every part that is given must be met."""

    one_of: dict[str, list] = field(default_factory=dict)
    between: dict[str, tuple] = field(default_factory=dict)  # inclusive; either end may be None
    present: list[str] = field(default_factory=list)
    differs: dict[str, object] = field(default_factory=dict)  # null-safe inequality
    words: dict[str, list[str]] = field(default_factory=dict)
    box: Box | None = None
    box_columns: tuple[str, str] = ("x", "y")

    def predicate(self, without: str | None = None) -> Column:
        """The whole, or all but what concerns the column ``without`` (for a facet that ignores its own choice)."""
        parts = [F.col(c).isin(list(v)) for c, v in self.one_of.items() if v and c != without]
        for c, (low, high) in self.between.items():
            if c != without:
                parts += [F.col(c) >= low] if low is not None else []
                parts += [F.col(c) <= high] if high is not None else []
        parts += [F.col(c).isNotNull() for c in self.present if c != without]
        parts += [~F.col(c).eqNullSafe(v) for c, v in self.differs.items() if c != without]
        parts += [contains_any(c, w) for c, w in self.words.items() if c != without]
        parts += [self.box.holds(*self.box_columns)] if self.box else []
        return all_of(parts)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())


#: Fixed value: how an identifier such as "gmb-2024-123" looks.
ID_PATTERN = r"^[A-Za-z]{2,5}-\d{4}-\d+$"


def search_predicate(q: str | None, id_columns: list[str], text_column: str) -> Column:
    """What a search box means: an identifier is looked up exactly, other words must all begin a word of the text, nothing is no filter."""
    q = (q or "").strip()
    if not q:
        return F.lit(True)
    if re.match(ID_PATTERN, q):
        return any_of(F.col(c) == q for c in id_columns)
    words = re.findall(r"\w+", q.lower())[:10]
    tokens = F.split(F.lower(F.col(text_column)), r"[^\p{L}\p{N}_]+")
    begins = lambda w: F.exists(tokens, lambda t: F.startswith(t, F.lit(w)))
    return all_of(map(begins, words))


def exists_chains(df: DataFrame, key: str, categories: list[list[tuple[DataFrame, str]]]) -> DataFrame:
    """Rows for which every category holds: within one, a row of any of its tables must have the key (semi joins)."""
    for options in categories:
        if options:
            found = reduce(DataFrame.union, [t.select(F.col(c).alias(key)) for t, c in options])
            df = df.join(found, key, "left_semi")
    return df


def snippet(text: Column, word: str, before: int = 30, width: int = 120) -> Column:
    """The text around the first match, with ellipses where it is cut; without a match its beginning."""
    at = F.instr(F.lower(text), word.lower())
    start = F.greatest(at - before, F.lit(1))
    cut = F.substr(text, start, F.lit(before + width))
    around = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + before + width <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, around).otherwise(F.left(text, F.lit(width)))


def parse_list(text: str | None) -> list[str] | None:
    """A comma-separated parameter; nothing in it is None."""
    parts = [p.strip() for p in (text or "").split(",") if p.strip()]
    return parts or None


def camel_case(df: DataFrame) -> DataFrame:
    """Column names from snake_case to camelCase, dates as ISO text."""
    out = []
    for name, kind in df.dtypes:
        head, *rest = name.split("_")
        c = F.date_format(name, "yyyy-MM-dd") if kind == "date" else F.col(name)
        out.append(c.alias(head + "".join(p.capitalize() for p in rest)))
    return df.select(*out)
