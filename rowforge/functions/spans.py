"""Column spans of a line: character positions or delimited fields, to read, rewrite or delete."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArguments
from ..plans import ranges
from .regexes import quote

MAX = 2147483647


def _gaps(parts: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """What lies before, between and after merged parts."""
    out, at = [], 1
    for a, b in parts:
        if a > at:
            out.append((at, a - 1))
        if b is ranges.END:
            return out
        at = b + 1
    return [*out, (at, ranges.END)]


@dataclass(frozen=True)
class Span:
    """``fields`` is the delimiter; without it positions count characters."""

    spec: str
    fields: str | None = None
    quoted: bool = False
    output_delimiter: str | None = None

    def __post_init__(self):
        if self.fields == "":
            raise InvalidArguments("the field delimiter is empty")
        ranges.columns(self.spec)

    @property
    def written(self):
        return ranges.columns(self.spec)

    @property
    def normal(self):
        return ranges.merged(self.written)

    def split(self, line: Column) -> Column:
        """All fields of a line; quotes stay in them."""
        d = quote(self.fields)
        if not self.quoted:
            return F.split(line, d, -1)
        # one character can be left out of a class, which is faster than a look ahead at every place
        single = len(self.fields) == 1 and (self.fields.isalnum() or self.fields in ",;|:\t /_")
        plain = f'[^"{self.fields}]++' if single else f'(?!{d})[^"]'
        token = f'{d}((?:{plain}|"[^"]*+(?:"|\\z))*+)'
        return F.regexp_extract_all(F.concat(F.lit(self.fields), line), F.lit("(?s)" + token), F.lit(1))

    def _part(self, line: Column, a: int, b: int | None) -> Column:
        """The text of a part; null if it is beyond the line."""
        if self.fields is None:
            return F.when(F.length(line) >= a, F.substring(line, a, MAX if b is ranges.END else b - a + 1))
        parts = self.split(line)
        if a == b:
            return F.get(parts, F.lit(a - 1))
        n = F.size(parts)
        last = n if b is ranges.END else F.least(n, F.lit(b))
        return F.when(n >= a, F.array_join(F.slice(parts, F.lit(a), last - a + 1), self.fields))

    def _join(self, parts: list[Column], joiner: str) -> Column:
        """Parts that are not there leave no joiner."""
        return F.concat_ws(joiner, *parts) if parts else F.lit("")

    def read(self, line: Column) -> Column:
        joiner = "" if self.fields is None else self.fields if self.output_delimiter is None else self.output_delimiter
        parts = [self._part(line, a, b) for a, b in self.written]
        return F.coalesce(parts[0], F.lit("")) if len(parts) == 1 else self._join(parts, joiner)

    def write(self, line: Column, f: Callable[[Column], Column]) -> Column:
        """Every part that covers characters, rewritten where it stands."""
        own = {a: b for a, b in self.normal}
        chunks = []
        for a, b in sorted([*own.items(), *_gaps(self.normal)], key=lambda p: p[0]):
            part = self._part(line, a, b)
            chunks.append(F.when(part != "", f(part)).otherwise(part) if a in own and own[a] == b else part)
        return self._join(chunks, self.fields or "")

    def delete(self, line: Column) -> Column:
        """The line without the parts, each with one delimiter."""
        return self._join([self._part(line, a, b) for a, b in _gaps(self.normal)], self.fields or "")
