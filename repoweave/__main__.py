"""Command line: ``python -m repoweave prepare --config C [-y]`` and ``python -m repoweave jsonl IN OUT --length N``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from repoweave.functions.text import MAX_INT
from repoweave.plans.prepare import CorpusConfig, prepare
from repoweave.session import build_session
from repoweave.sinks.corpus import to_jsonl
from repoweave.sources.tables import read_corpus


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="repoweave")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("prepare", help="build a corpus from a configuration")
    build.add_argument("--config", required=True)
    build.add_argument("-y", action="store_true", help="overwrite existing output")
    export = commands.add_parser("jsonl", help="cut the content of a corpus and write JSON Lines")
    export.add_argument("source")
    export.add_argument("target")
    export.add_argument("--length", type=int, default=MAX_INT)
    export.add_argument("-y", action="store_true", help="overwrite existing output")
    options = parser.parse_args(arguments)

    spark = build_session()
    if options.command == "prepare":
        prepare(spark, replace(CorpusConfig.from_yaml(options.config), overwrite=options.y))
    else:
        mode = "overwrite" if options.y else "errorifexists"
        to_jsonl(read_corpus(spark, options.source), options.target, options.length, mode=mode)


if __name__ == "__main__":
    main()
