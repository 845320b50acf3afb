"""The one plan of a job: select rows, rewrite lines, split, reorder, make distinct, reduce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import regexes, text
from ..operators.ordering import Order, positions, sort_columns
from ..sources.lines import LineFrame
from .options import TextJob
from .ranges import Rows

VALUES = ("sum", "avg", "min", "max")


@dataclass
class Result:
    """``rows`` in the order of ``order``; ``summary`` names the value columns of a summary. ``matched`` has the
    rows that the job worked on. ``dense``: the order is the rows' number from 1."""

    rows: DataFrame
    order: Order
    matched: DataFrame
    summary: tuple[str, ...] = ()
    separator: str = "\t"
    dense: bool = False

    def to_table(self) -> DataFrame:
        """``pos`` with ``content``, or with the typed summary; a summary over all rows is one row without pos."""
        if self.summary and not self.order:
            return self.rows
        columns = self.summary or ("content",)
        if self.dense:
            return self.rows.select(F.col(self.order[0][0]).cast("long").alias("pos"), *columns)
        return positions(self.rows, self.order, "pos").select("pos", *columns)

    def to_text(self) -> DataFrame:
        """``content, terminator`` in order (a sorted frame)."""
        rows = self.rows
        if self.summary:
            from .format import plain

            cells = [plain(F.col(c)) if c in VALUES else F.col(c).cast("string") for c in self.summary]
            rows = rows.withColumn("content", F.concat_ws(self.separator, *[F.coalesce(c, F.lit("")) for c in cells])).withColumn("terminator", F.lit("\n"))
        return (rows.orderBy(*sort_columns(self.order)) if self.order else rows).select("content", "terminator")

    def any_match(self) -> bool:
        return not self.matched.limit(1).isEmpty()


def _selected(job: TextJob, lines: LineFrame) -> tuple[Column, Column]:
    """Conditions: the row is in range; its raw line matches."""
    in_rows = F.lit(True)
    if job.rows is not None:
        rows = Rows.parse(job.rows)
        in_rows = rows.condition(F.col("row_no"), lines.total if rows.needs_total else None)
    matches = F.lit(True)
    if job.grep is not None:
        pattern = regexes.compiled(job.grep, job.ignore_case)[0]
        where = job.span(job.cols).read(F.col("content")) if job.cols is not None else F.col("content")
        matches = F.rlike(where, F.lit(pattern))
        matches = ~matches if job.invert else matches
    return in_rows, matches


def _rewritten(job: TextJob, line: Column) -> Column:
    """The steps that keep one line one line, in their order."""
    span = job.span(job.cols) if job.cols is not None else None
    if job.delete and span is not None:
        return span.delete(line)
    steps = [text.replace(f, r, job.ignore_case, job.regex) for f, r in zip(job.find, job.replace)]
    steps += [f for on, f in ((job.upper, text.upper), (job.lower, text.lower), (job.title_case, text.title_case), (job.squeeze, text.squeeze), (job.trim, text.trim)) if on]
    claimed = steps or job.grep is not None or (job.sort and job.sort_key is None) or (job.unique and job.unique_key is None)
    if span is not None and not claimed:
        line = span.read(line)
    for f in steps:
        line = span.write(line, f) if span is not None else F.when(line != "", f(line)).otherwise(line)
    for f in job.extra:
        line = f(line)
    return line


def is_blocking(job: TextJob) -> bool:
    """Whether a job needs the end of its input, or a count of the rows before."""
    return bool(job.rows or job.sort or job.tac or job.shuffle or job.unique or job.number or job.join is not None)


def stateless(job: TextJob, df: DataFrame) -> DataFrame:
    """The steps of a job that look at one line at a time, on any frame with a column ``content``."""
    _, matches = _selected(job, LineFrame(df, _total=0)) if job.rows is None else (None, F.lit(True))
    if job.grep is not None:
        df = df.filter(~matches if job.delete and job.cols is None else matches) if not (job.delete and job.cols) else df
    line = _rewritten(job, F.col("content"))
    if job.delete and job.cols is None:
        line = F.col("content")
    elif job.delete and job.grep is not None:
        line = F.when(matches, line).otherwise(F.col("content"))
    df = df.withColumn("content", line)
    if job.split_on is not None:
        df = df.withColumn("content", F.explode(text.split_literal(F.col("content"), job.split_on)))
    if job.wrap is not None:
        df = df.withColumn("content", F.explode(text.wrap(F.col("content"), job.wrap)))
    return df.filter("content != ''") if job.drop_empty else df


def aggregates(job: TextJob) -> list[Column]:
    def values(name):
        return text.number(job.span(getattr(job, name)).read(F.col("content")))

    out = [F.count(F.lit(1)).alias("count")] if job.count else []
    if job.sum is not None:
        out.append(F.coalesce(F.sum(values("sum")), F.lit(0.0)).alias("sum"))
    return out + [getattr(F, n)(values(n)).alias(n) for n in ("avg", "min", "max") if getattr(job, n) is not None]


def plan(job: TextJob, lines: LineFrame) -> Result:
    """Nothing runs but what numbers rows: for ranges of rows, error messages, numbering, and edits in a new order."""
    job.validate()
    edit = job.delete and job.cols is not None
    moves = job.sort or job.tac or job.shuffle
    if job.rows is not None or lines.validate or (edit and moves):
        lines = lines.numbered()
    df, total, dense = lines.df, lines._total, lines.dense
    in_rows, matches = _selected(job, lines)
    if lines.validate and not (job.delete and job.cols is None and job.grep is None):
        bad = F.raise_error(F.concat(F.lit("invalid UTF-8 in line "), F.col("row_no").cast("string")))
        df = df.withColumn("content", F.when(in_rows & ~F.is_valid_utf8("content"), bad.cast("string")).otherwise(F.col("content")))
    on = in_rows & matches
    matched = df.filter(on)
    order: Order = list(lines.order)
    if job.delete and not edit:
        return Result(df.filter(~on), order, matched)
    if edit:
        df = df.withColumn("on", on).withColumn("content", F.when(F.col("on"), _rewritten(job, F.col("content"))).otherwise(F.col("content")))
    else:
        if job.rows is not None or job.grep is not None:
            df, total, dense = df.filter(on), None, False
        df = df.withColumn("content", _rewritten(job, F.col("content")))
    for name, pieces in (("split_pos", job.split_on and text.split_literal(F.col("content"), job.split_on)), ("wrap_pos", job.wrap and text.wrap(F.col("content"), job.wrap))):
        if pieces is not None:
            n = "terminator"
            size = F.size("pieces")
            df = df.withColumn("pieces", pieces).select(*[c for c in df.columns if c not in ("content", n)], "terminator", size.alias("n_pieces"), F.posexplode("pieces").alias(name, "content"))
            df = df.withColumn(n, F.when((F.col(name) < F.col("n_pieces") - 1) & (F.col(n) == ""), "\n").otherwise(F.col(n))).drop("n_pieces")
            order, total, dense = [*order, (name, False)], None, False
    if job.drop_empty:
        df, total, dense = df.filter("content != ''"), None, False
    if job.number:
        df = positions(df, order, "nth", total)
        df = df.withColumn("content", F.concat(F.col("nth").cast("string"), F.lit(job.separator), F.col("content")))
        order, dense = [("nth", False)], True
    df, order = _reordered(job, df, order, edit)
    dense = dense and not moves
    if job.unique:
        spec = job.unique_key if job.unique_key is not None else job.cols
        key = F.col("content") if spec is None else job.span(spec).read(F.col("content"))
        dense = False
        if job.summary and job.group_by is None and all(getattr(job, n) is None for n in VALUES):
            df = df.select(key.alias("key")).distinct()  # only their number matters
        else:  # the first row of each key, found before rows are shuffled
            df, order = _rising(df, order)
            first = F.struct(*[_sortable(c, desc) for c, desc in order])
            rest = [c for c in df.columns]
            df = df.withColumn("unique_key", key).groupBy("unique_key").agg(F.min_by(F.struct(*rest), first).alias("row")).select("row.*")
    if job.join is not None:
        line = F.struct(*[_sortable(c, desc) for c, desc in order], F.col("content"))
        df = df.agg(F.array_sort(F.collect_list(line)).alias("all")).filter(F.size("all") > 0)
        df = df.select(F.array_join(F.transform("all", lambda x: x["content"]), job.join).alias("content"), F.lit("\n").alias("terminator"), F.lit(1).alias("row_no"))
        return Result(df, [("row_no", False)], matched, dense=True)
    if job.summary:
        names = tuple(n for n in ("count", *VALUES) if (job.count if n == "count" else getattr(job, n) is not None))
        if job.group_by is None:
            return Result(df.agg(*aggregates(job)), [], matched, names, job.separator)
        firsts = F.min(F.struct(*[_sortable(c, desc).alias(c) for c, desc in order])).alias("first_seen")
        df = df.withColumn("key", job.span(job.group_by).read(F.col("content"))).groupBy("key").agg(*aggregates(job), firsts)
        return Result(df, [("first_seen", False)], matched, ("key", *names), job.separator)
    return Result(df, order, matched, dense=dense)


def _sortable(name: str, desc: bool) -> Column:
    """A value that sorts ascending as the column does in its direction; only numbers are ever descending here."""
    return -F.col(name) if desc else F.col(name)


def _rising(df: DataFrame, order: Order) -> tuple[DataFrame, Order]:
    """The rows with an order whose descending columns, if any, are numbers and never null."""
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and not f.nullable}
    if all(c in numbers for c, desc in order if desc):
        return df, order
    return positions(df, order, "out_pos"), [("out_pos", False)]


def _reordered(job: TextJob, df: DataFrame, order: Order, edit: bool) -> tuple[DataFrame, Order]:
    if not (job.sort or job.tac or job.shuffle):
        return df, order
    keys: Order
    if job.sort:
        spec = job.sort_key if job.sort_key is not None else job.cols
        key = F.col("content") if spec is None else job.span(spec).read(F.col("content"))
        if job.numeric:
            num = text.number(key)
            df = df.withColumn("sort_num", num).withColumn("sort_zero", F.when(num.cast("string") == "-0.0", 0).otherwise(1))
            keys = [("sort_num", job.reverse), ("sort_zero", job.reverse), *order]
        else:
            df, keys = df.withColumn("sort_key", key), [("sort_key", job.reverse), *order]
    elif job.tac:
        keys = [(c, True) for c, _ in order]
    else:
        names = [c for c, _ in order]
        mixed = F.rand() if job.seed is None else F.xxhash64(*[F.col(c) for c in names], F.lit(job.seed))
        df, keys = df.withColumn("mixed", mixed), [("mixed", False), *order]
    if not edit:
        return _rising(df, keys) if job.join is not None or job.group_by is not None else (df, keys)
    # A run of edited rows is reordered in place: its number is that of the kept rows before it.
    on, kept = df.filter("on"), df.filter(~F.col("on"))
    on = positions(on, [("row_no", False)], "nth").withColumn("run", F.col("row_no") - F.col("nth")).drop("nth")
    kept = positions(kept, [("row_no", False)], "run")
    kept = kept.withColumn("run", F.col("run"))
    both = on.withColumn("edited", F.lit(1)).unionByName(kept.withColumn("edited", F.lit(0)))
    return both, [("run", False), ("edited", False), *keys]
