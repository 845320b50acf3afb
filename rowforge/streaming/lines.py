"""Jobs over streams of lines.

What looks at one line at a time runs as it is; summaries run in complete mode. Jobs that need the end of the input, or
a count of all rows before, are refused on an unbounded stream: run them with plan() once the input is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArguments
from ..plans.options import TextJob
from ..plans.planner import aggregates, is_blocking, stateless


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``content`` over the text files that come into a folder."""
    value = F.col("value")
    lines = spark.readStream.option("lineSep", "\n").text(path)
    return lines.select(F.when(value.endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(value).alias("content"))


def stream(job: TextJob, lines: DataFrame) -> DataFrame:
    """The job over a streaming frame with a column ``content``; a summary must be written in complete mode."""
    job.validate()
    if is_blocking(job):
        raise InvalidArguments("this job needs the end of its input; it cannot run on an unbounded stream")
    rows = stateless(job, lines)
    if not job.summary:
        return rows
    if job.group_by is None:
        return rows.agg(*aggregates(job))
    return rows.withColumn("key", job.span(job.group_by).read(F.col("content"))).groupBy("key").agg(*aggregates(job))
