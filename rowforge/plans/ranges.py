"""Row and column ranges: 1-based, inclusive, resolved when a plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArguments

END = None  # an open upper bound


def _number(text: str, what: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) == 0:
        raise InvalidArguments(f"{what}: {text!r} is not a position from 1")
    return int(text)


def merged(parts: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """Sorted, with overlapping and adjacent parts as one."""
    out: list[tuple[int, int | None]] = []
    for a, b in sorted(parts, key=lambda p: p[0]):
        if out and (out[-1][1] is END or a <= out[-1][1] + 1):
            last = out[-1][1]
            out[-1] = (out[-1][0], END if END in (last, b) else max(last, b))
        else:
            out.append((a, b))
    return out


def columns(spec: str) -> list[tuple[int, int | None]]:
    """A column list in the order written: ``3,1,5-7,9-``."""
    out = []
    for part in spec.split(","):
        ends = part.split("-")
        if len(ends) > 2 or ends == ["", ""]:
            raise InvalidArguments(f"columns: cannot read {part!r}")
        a = _number(ends[0], "columns") if ends[0] else 1
        b = a if len(ends) == 1 else _number(ends[1], "columns") if ends[1] else END
        if b is not END and b < a:
            raise InvalidArguments(f"columns: {part!r} is inverted")
        out.append((a, b))
    return out


@dataclass(frozen=True)
class Bound:
    at: int
    from_end: bool = False


@dataclass(frozen=True)
class Rows:
    """Row ranges, some perhaps counted from the end (``~1`` is the last row)."""

    parts: tuple[tuple[Bound | None, Bound | None], ...]

    @classmethod
    def parse(cls, spec: str) -> Rows:
        def bound(text: str) -> Bound | None:
            if not text:
                return None
            return Bound(_number(text[1:], "rows"), True) if text[0] == "~" else Bound(_number(text, "rows"))

        parts = []
        for part in spec.split(","):
            ends = part.split("-")
            if len(ends) > 2 or ends in (["", ""], [""]):
                raise InvalidArguments(f"rows: cannot read {part!r}")
            a, b = bound(ends[0]), bound(ends[-1])
            if a and b and a.from_end == b.from_end and (b.at > a.at if a.from_end else b.at < a.at):
                raise InvalidArguments(f"rows: {part!r} is inverted")
            parts.append((a, b))
        return cls(tuple(parts))

    @property
    def needs_total(self) -> bool:
        return any(x is not None and x.from_end for part in self.parts for x in part)

    def resolve(self, total: int | None = None) -> list[tuple[int, int | None]]:
        out = []
        for a, b in self.parts:
            first = 1 if a is None else a.at if not a.from_end else max(1, total + 1 - a.at)
            last = END if b is None else b.at if not b.from_end else max(0, total + 1 - b.at)
            if a is not None and a == b and a.from_end and a.at > total:
                continue
            if last is END or first <= last:
                out.append((first, last))
        return merged(out)

    def condition(self, row_no: Column, total: int | None = None) -> Column:
        on = F.lit(False)
        for a, b in self.resolve(total):
            on = on | (row_no >= a if b is END else row_no == a if a == b else row_no <= b if a == 1 else row_no.between(a, b))
        return on
