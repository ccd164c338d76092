"""What the jobs' command lines and registered queries share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def with_defaults(config: dict | None, defaults: dict) -> dict:
    """The settings of a job; a name that it doesn't know is an error."""
    unknown = set(config or {}) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | (config or {})


def command_line(description: str, run: Callable[..., DataFrame], paths: dict[str, str], options: dict[str, str] | None = None, argv: list[str] | None = None) -> None:
    """Runs a job from the command line: its paths, its options, and a file of settings as JSON. Creates a session and stops
    it."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", help="a JSON file of settings")
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    for name, what in (options or {}).items():
        parser.add_argument(f"--{name}", help=what)
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = given.pop("config")
    settings = json.load(open(config)) if config else None
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        run(spark, config=settings, **given)
    finally:
        spark.stop()
