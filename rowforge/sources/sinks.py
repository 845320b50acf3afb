"""Sinks: ordered text to one file, in-place edits with backup and dry run, and the exit code.

A byte-exact ordered file has one writer; rows stream through the driver one partition at a time and are never
held as a whole. ``write_parts`` writes the same order as many part files in parallel.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import Backup, CreateOutput, InvalidArguments, OpenInput, OutputIsInput, Processing, ReplaceInput
from ..plans.options import TextJob
from ..plans.planner import Result, plan
from .lines import from_files


@contextmanager
def processing() -> Iterator[None]:
    """Spark's failures as an error of this library, with the line if a line is at fault."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        found = re.search(r"invalid UTF-8 in line [0-9]+", str(e))
        raise Processing(found[0] if found else str(e).strip().split("\n")[0]) from e


def chunks(result: Result) -> Iterator[bytes]:
    """The output's bytes; a row without a terminator gets one if something follows."""
    owed = b""
    with processing():
        for row in result.to_text().select(F.col("content").cast("binary"), "terminator").toLocalIterator(prefetchPartitions=True):
            yield owed + bytes(row[0] or b"") + row[1].encode()
            owed = b"" if row[1] else b"\n"


def refuse_alias(output: str, inputs: list[str]) -> None:
    for path in inputs:
        if os.path.exists(path) and os.path.exists(output) and os.path.samefile(path, output):
            raise OutputIsInput(f"{output} is one of the inputs")


def write_file(result: Result, path: str, inputs: list[str] = ()) -> None:
    refuse_alias(path, list(inputs))
    try:
        f = open(path, "wb")  # noqa: SIM115
    except OSError as e:
        raise CreateOutput(f"cannot create {path}: {e.strerror}") from e
    with f:
        f.writelines(chunks(result))


def write_parts(result: Result, path: str) -> None:
    """A folder of part files, in order by name."""
    result.to_text().select("content").write.option("lineSep", "\n").text(path)


def edit_in_place(spark: SparkSession, job: TextJob, paths: list[str], backup: str | None = None) -> bool:
    """Rewrites every distinct file by a job of its own; whether any row of any matched."""
    if backup == "":
        raise InvalidArguments("the backup suffix is empty")
    matched = False
    for path in dict.fromkeys(os.path.realpath(p) for p in paths):
        if not os.path.exists(path):
            raise OpenInput(f"cannot open {path}")
        result = plan(job, from_files(spark, [path]))
        try:
            fd, staged = tempfile.mkstemp(prefix=f".{os.path.basename(path)}.", dir=os.path.dirname(path))
        except OSError as e:
            raise CreateOutput(f"cannot write beside {path}: {e.strerror}") from e
        try:
            with os.fdopen(fd, "wb") as f:
                f.writelines(chunks(result))
                f.flush()
                os.fsync(f.fileno())
            shutil.copymode(path, staged)
            matched |= any_match(result)
            if backup is not None:
                try:
                    shutil.copy2(path, path + backup)
                except OSError as e:
                    raise Backup(f"cannot back up {path}: {e.strerror}") from e
            try:
                os.replace(staged, path)
            except OSError as e:
                raise ReplaceInput(f"cannot replace {path}: {e.strerror}") from e
        except BaseException:
            Path(staged).unlink(missing_ok=True)
            raise
    return matched


def would_change(spark: SparkSession, job: TextJob, paths: list[str]) -> dict[str, bool]:
    """For every distinct file whether an edit in place would change it; reads on only until a difference."""
    out = {}
    for path in dict.fromkeys(os.path.realpath(p) for p in paths):
        result = plan(job, from_files(spark, [path]))
        with open(path, "rb") as f:
            out[path] = any(f.read(len(c)) != c for c in chunks(result)) or bool(f.read(1))
    return out


def any_match(result: Result) -> bool:
    with processing():
        return result.any_match()


def exit_code(job: TextJob, matched: bool) -> int:
    return 0 if job.grep is None or matched else 1
