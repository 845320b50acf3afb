"""A job's options and the rules by which they go together."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import InvalidArguments
from ..functions.spans import Span
from .ranges import Rows, columns


@dataclass(frozen=True)
class TextJob:
    rows: str | None = None
    cols: str | None = None
    fields: str | None = None
    quoted: bool = False
    output_delimiter: str | None = None
    delete: bool = False
    grep: str | None = None
    invert: bool = False
    ignore_case: bool = False
    find: tuple[str, ...] = ()
    replace: tuple[str, ...] = ()
    regex: bool = False
    upper: bool = False
    lower: bool = False
    title_case: bool = False
    squeeze: bool = False
    trim: bool = False
    split_on: str | None = None
    wrap: int | None = None
    drop_empty: bool = False
    number: bool = False
    sort: bool = False
    numeric: bool = False
    reverse: bool = False
    sort_key: str | None = None
    tac: bool = False
    shuffle: bool = False
    seed: int | None = None
    unique: bool = False
    unique_key: str | None = None
    count: bool = False
    sum: str | None = None
    avg: str | None = None
    min: str | None = None
    max: str | None = None
    group_by: str | None = None
    join: str | None = None
    quiet: bool = False
    #: further steps for every line, each Column -> Column
    extra: tuple = field(default=(), compare=False)

    @property
    def summary(self) -> bool:
        return self.count or any(x is not None for x in (self.sum, self.avg, self.min, self.max))

    @property
    def separator(self) -> str:
        return self.output_delimiter if self.output_delimiter is not None else self.fields if self.fields is not None else "\t"

    def span(self, spec: str) -> Span:
        return Span(spec, self.fields, self.quoted, self.output_delimiter)

    def validate(self) -> TextJob:
        """Raises InvalidArguments for options that do not go together."""

        def need(on, other, text):
            if on and not other:
                raise InvalidArguments(text)

        def clash(*named):
            on = [n for n, x in named if x]
            if len(on) > 1:
                raise InvalidArguments(f"{' and '.join(on[:2])} do not go together")

        ranges = [x for x in (self.cols, self.sort_key, self.unique_key, self.sum, self.avg, self.min, self.max, self.group_by) if x is not None]
        need(self.fields is not None, ranges, "fields needs a column range")
        need(self.quoted, self.fields is not None, "quoted needs fields")
        need(self.output_delimiter is not None, self.fields is not None, "output_delimiter needs fields")
        need(self.sort_key is not None or self.numeric or self.reverse, self.sort, "sort_key, numeric and reverse need sort")
        need(self.unique_key is not None, self.unique, "unique_key needs unique")
        need(self.group_by is not None, self.summary, "group_by needs a summary")
        need(self.quiet, self.grep is not None, "quiet needs grep")
        need(self.invert, self.grep is not None, "invert needs grep")
        need(self.ignore_case, self.grep is not None or self.find, "ignore_case needs grep or find")
        need(self.regex, self.find, "regex needs find")
        clash(("sort", self.sort), ("tac", self.tac), ("shuffle", self.shuffle))
        clash(("upper", self.upper), ("lower", self.lower), ("title_case", self.title_case))
        clash(("join", self.join is not None), ("a summary", self.summary))
        for other in ("sort", "tac", "shuffle", "summary"):
            clash(("number", self.number), (other, getattr(self, other)))
        clash(("number", self.number), ("join", self.join is not None))
        for other in ("unique", "upper", "lower", "title_case", "squeeze", "trim", "split_on", "wrap", "drop_empty", "number", "join", "summary"):
            clash(("delete", self.delete), (other, getattr(self, other) not in (None, False)))
        if len(self.find) != len(self.replace):
            raise InvalidArguments("find and replace come in pairs" if self.find and self.replace else "replace needs find" if self.replace else "find needs replace")
        clash(("delete", self.delete), ("replace", self.find))
        if self.delete:
            need(True, self.rows or self.cols or self.grep is not None, "delete needs rows, columns or grep")
            if not self.cols and (self.sort or self.tac or self.shuffle):
                raise InvalidArguments("rows to delete have no order")
        if self.split_on == "" or (self.wrap is not None and self.wrap < 1):
            raise InvalidArguments("split_on is empty" if self.split_on == "" else "wrap needs a width from 1")
        if self.rows is not None:
            Rows.parse(self.rows)
        for spec in ranges:
            columns(spec)
            self.span(spec)
        return self
