"""The command line: ``python -m rowforge.cli [options] [files]``; exit code 0, 1 (grep matched nothing) or 2."""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys

from .errors import InvalidArguments, RowforgeError
from .plans.options import TextJob

SHORT = {"rows": "-R", "cols": "-C", "fields": "-F", "delete": "-d", "grep": "-g", "invert": "-v", "find": "-f", "replace": "-r", "regex": "-e", "sort": "-s", "numeric": "-n", "unique": "-u", "quiet": "-q"}
#: Which options are words of their own, by type.
SKIP = {"extra"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rowforge", description="Select, rewrite, sort and summarize lines.")
    for f in dataclasses.fields(TextJob):
        if f.name in SKIP:
            continue
        names = [x for x in (SHORT.get(f.name), "--" + f.name.replace("_", "-")) if x]
        if f.type == "bool":
            out.add_argument(*names, dest=f.name, action="store_true")
        elif f.name in ("find", "replace"):
            out.add_argument(*names, dest=f.name, action="append", default=[])
        else:
            out.add_argument(*names, dest=f.name, type=int if f.type.startswith("int") else str)
    out.add_argument("-o", "--output")
    out.add_argument("-i", "--in-place", action="store_true")
    out.add_argument("--backup")
    out.add_argument("--dry-run", action="store_true")
    out.add_argument("files", nargs="*")
    return out


def job_of(args: argparse.Namespace) -> TextJob:
    values = {f.name: getattr(args, f.name) for f in dataclasses.fields(TextJob) if f.name not in SKIP}
    job = TextJob(**values | {"find": tuple(args.find), "replace": tuple(args.replace)}).validate()
    if args.in_place and (args.output or job.quiet or not args.files or "-" in args.files):
        raise InvalidArguments("in-place needs files, and neither output nor quiet")
    if job.quiet and args.output:
        raise InvalidArguments("quiet and output do not go together")
    if not args.in_place and (args.backup is not None or args.dry_run):
        raise InvalidArguments("backup and dry-run need in-place")
    return job


def main(argv: list[str] | None = None, spark=None, stdin=None, stdout=None) -> int:
    stdin, stdout = stdin or sys.stdin.buffer, stdout or sys.stdout.buffer
    try:
        args = parser().parse_args(argv)
        job = job_of(args)
        from pyspark.sql import SparkSession

        from .plans.planner import plan
        from .sources import sinks
        from .sources.lines import from_files, staged

        spark = spark or SparkSession.builder.getOrCreate()
        if args.in_place and args.dry_run:
            for path, changes in sinks.would_change(spark, job, args.files).items():
                stdout.write(f"{path}: {'would change' if changes else 'unchanged'}\n".encode())
            return 0
        if args.in_place:
            return sinks.exit_code(job, sinks.edit_in_place(spark, job, args.files, args.backup))
        files = args.files or ["-"]
        # standard input goes to a file as it comes; a second mention of it has nothing more to give
        paths = [staged(spark, stdin) if f == "-" else f for f in files]
        result = plan(job, from_files(spark, paths))
        some = False
        if args.output:
            sinks.write_file(result, args.output, [f for f in files if f != "-"])
        elif not job.quiet:
            for chunk in sinks.chunks(result):
                stdout.write(chunk)
                some = True
            stdout.flush()
        # whatever comes out of a grep that keeps its matches is one
        some = some and not job.delete and not job.summary and job.join is None
        return sinks.exit_code(job, job.grep is None or some or sinks.any_match(result))
    except BrokenPipeError:
        if stdout is sys.stdout.buffer:
            os.dup2(os.open(os.devnull, os.O_WRONLY), 1)
        return 0
    except SystemExit as e:
        return int(e.code or 0)
    except (RowforgeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
