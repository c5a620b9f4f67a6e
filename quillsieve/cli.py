"""Command line: check, fix and rewrite files."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__
from .functions import settings as options


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillsieve", description="Cleans texts, images and office files.")
    top.add_argument("--version", version=f"quillsieve {__version__}", action="version")
    commands = top.add_subparsers(required=True, dest="command")
    for p in map(commands.add_parser, ("fix", "check")):
        p.add_argument("paths", nargs="*", help="files or folders, or - for standard input; by default this folder")
        p.add_argument("--config")
        for flag in "aggressive json no-backup no-voice quiet strict".split():
            p.add_argument(f"--{flag}", action="store_true")
    p = commands.add_parser("staged", help="clean what is staged for a git commit, and stage it again")
    p.add_argument("--config")
    p = commands.add_parser("gate", help="fix, but for the voice layer, then check")
    p.add_argument("paths", nargs="*")
    p.add_argument("--config")
    p = commands.add_parser("rewrite", help="translate to another language and back (sends texts to a service)")
    p.add_argument("paths", nargs="+")
    p.add_argument("--source-lang")
    p.add_argument("--pivot-lang", metavar="LANG", default="EN")
    p.add_argument("--write", action="store_true")
    p.add_argument("--config")
    return top


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillsieve").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _scan(args: argparse.Namespace) -> int:
    from .sources import runs

    paths, write = args.paths or ["."], args.command == "fix"
    how = options.load(args.config, "." if paths[0] == "-" else paths[0])
    if args.no_voice:
        how["voice"] = False
    if args.aggressive:
        how = options.aggressive(how)
    if args.no_backup:
        how["backup"] = False
    where = sys.stdout
    if "-" in paths:
        if len(paths) > 1:
            sys.stderr.write("stdin (-) cannot be combined with file paths\n")
            return 2
        one, content = runs.clean_bytes(sys.stdin.buffer.read(), how)
        reports = [one]
        if write:
            sys.stdout.buffer.write(content)
            sys.stdout.buffer.flush()
            where = sys.stderr
    else:
        reports = runs.scan(_session(), paths, how, write)
    if args.json:
        print(runs.as_json(reports, write), file=where)
    else:
        if not args.quiet:
            for r in reports:
                if r["findings"]:
                    print(runs.rendered(r, write), file=where)
        print(f"\n{runs.summarised(reports, write)}", file=where)
    return runs.exit_code(reports, args.strict, write)


def _staged(args: argparse.Namespace) -> int:
    from .sources import runs, staged

    how = options.load(args.config) | {"voice": False, "backup": False}
    whole, partial = staged.files(how)
    if whole:
        changed = [r["path"] for r in runs.reports(_session(), whole, how, True) if r["changed"]]
        staged.add(changed)
        print(f"cleaned and staged {len(changed)} of {len(whole)} staged files")
    if partial:
        print(f"left {len(partial)} files alone that are staged in part")
    return 0


def _gate(args: argparse.Namespace) -> int:
    from .sources import runs

    paths = args.paths or ["."]
    how, spark = options.load(args.config, paths[0]), _session()
    for _ in runs.reports(spark, paths, how | {"voice": False}, True):
        pass
    blocked = [r for r in runs.reports(spark, paths, how, False) if any(f["severity"] == "error" for f in r["findings"])]
    for r in blocked:
        print(runs.rendered(r, False))
    print(f"{len(blocked)} files block" if blocked else "nothing blocks")
    return int(bool(blocked))


def _rewrite(args: argparse.Namespace, client=None) -> int:
    from .functions import layers, translate
    from .sources import sink

    how, code = options.load(args.config, args.paths[0]), 0
    for path in args.paths:
        try:
            made = translate.back_and_forth(Path(path).read_text("utf-8"), client or translate.deepl(), args.source_lang, args.pivot_lang)
            made = layers.clean_text(made, how)[0]
            if args.write:
                sink.replace_file(path, made.encode("utf-8"))
            print(f"rewritten  {path}" if args.write else made)
        except Exception as failure:
            code = 1
            sys.stderr.write(f"error  {path}: {failure}\n")
    return code


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return {"rewrite": _rewrite, "staged": _staged, "gate": _gate}.get(args.command, _scan)(args)
    except (options.SettingsError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
