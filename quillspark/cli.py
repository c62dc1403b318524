"""Command line: one file or the standard input gives a report, several files a bundle report."""

from __future__ import annotations

import argparse
import os
import sys

from quillspark import __version__
from quillspark.functions.scan import bundle_report, report
from quillspark.sources import InputNotText, InputTooLarge, read_input, write_json

EXIT_ERROR = 1
EXIT_TOO_LARGE = 40


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        self.exit(EXIT_ERROR, f"{self.prog}: {message}\n")


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="quillspark", description="Report textual evidence in files as JSON.", allow_abbrev=False)
    p.add_argument("-V", "--version", action="version", version=f"quillspark {__version__}")
    p.add_argument("--allow-term", action="append", default=[], metavar="TERM", help="a term that the topic explains; may be given again")
    p.add_argument("files", nargs="*", metavar="FILE", help="none: the standard input; several: one bundle")
    return p


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0 done, 1 unreadable input or bad arguments, 40 an input over the size limit."""
    args = _parser().parse_args(argv)
    try:
        if len(args.files) > 1:
            out = bundle_report([(f, read_input(f)) for f in args.files], args.allow_term)
        else:
            out = report(read_input(args.files[0] if args.files else None), args.allow_term)
    except InputTooLarge as e:
        print(f"quillspark: {e}: more than 4 MiB", file=sys.stderr)
        return EXIT_TOO_LARGE
    except InputNotText as e:
        print(f"quillspark: {e}: not UTF-8", file=sys.stderr)
        return EXIT_ERROR
    except OSError as e:
        print(f"quillspark: {e}", file=sys.stderr)
        return EXIT_ERROR
    try:
        write_json(out, sys.stdout)
        sys.stdout.flush()
    except BrokenPipeError:  # the reader has seen enough
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    return 0


if __name__ == "__main__":
    sys.exit(main())
