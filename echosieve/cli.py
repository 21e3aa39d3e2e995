"""Command line: ``python -m echosieve.cli DIR``. Exit code 0: no copies, 1: copies found, 2: error."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from echosieve import __version__
from echosieve.config import AnalysisConfig, Scope
from echosieve.plans.report import duration, parse_spec, write_report
from echosieve.plans.session import Session
from echosieve.sources.encoding import parse_encoding


def _share(text: str) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("must be from 0 to 1")
    return x


def _count(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def _checked(parse):
    def run(text: str):
        try:
            parse(text)
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from None
        return text

    return run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echosieve", description="Find copied code.")
    p.add_argument("directory")
    p.add_argument("-t", "--threshold", type=_share, default=0.80, help="least similarity")
    p.add_argument("-m", "--min-tokens", type=int, default=30, help="least tokens of a block or region")
    p.add_argument("--text-sensitivity", type=_share, default=0.3, help="weight of names and literals")
    p.add_argument("-s", "--scope", type=_checked(Scope.parse), default="all", help="inter-file, intra-file, inter-function, intra-function, all; comma-separated")
    p.add_argument("-g", "--glob", action="append", default=[], help="file names to take, in place of the known extensions")
    p.add_argument("--encoding", type=_checked(parse_encoding), default="auto")
    p.add_argument("--gitignore", dest="no_ignore", action="store_false", help="leave out files that version control ignores (the default)")
    p.add_argument("--no-ignore", "--no-gitignore", dest="no_ignore", action="store_true", help="take files that version control ignores, too")
    p.add_argument("--diff-base", help="only copies that touch lines changed since this revision")
    p.add_argument("--report", "--reporter", action="append", default=[], type=_checked(parse_spec), help="console, json or json:file=PATH")
    p.add_argument("--limit", type=_count, help="only the first so many groups and blocks with repeated regions; all by default")
    p.add_argument("--show-source", dest="show_source", action="store_true", help="print the source of every block")
    p.add_argument("--no-source", dest="show_source", action="store_false")
    p.add_argument("-v", "--verbose", action="store_true", help="print how long each step took")
    p.add_argument("--version", action="version", version=f"echosieve {__version__}")
    p.add_argument("--mode", choices=("compat", "exact"), default="compat")
    return p


def main(args: list[str] | None = None) -> int:
    try:
        o = parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.appName("echosieve").getOrCreate()
    config = AnalysisConfig(
        root=o.directory, threshold=o.threshold, min_tokens=o.min_tokens, text_weight=o.text_sensitivity, scope=Scope.parse(o.scope), globs=tuple(o.glob), encoding=o.encoding, respect_ignore=not o.no_ignore, mode=o.mode
    )
    session = None
    try:
        session = Session(spark, config)
        if o.diff_base and not session.restrict_to_diff(o.diff_base):
            print("No relevant changes.")
            return 0
        for spec in o.report or ["console"]:
            write_report(session, spec, o.limit, o.show_source)
        if o.verbose:
            print(", ".join(f"{step} {duration(seconds)}" for step, seconds in session.timings.items()), file=sys.stderr)
        s = session.summary().first()
    except (OSError, RuntimeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        if session:
            session.close()
    return 1 if s.groups or s.intra_pairs else 0


if __name__ == "__main__":
    sys.exit(main())
