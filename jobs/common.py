"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import SparkSession


def command_line(name: str, about: str, paths: Iterable[str], run: Callable, given: list[str] | None = None) -> None:
    """Reads the paths and a JSON file of settings (the one beside the job unless --config names another), and runs the job in a session of its own."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).parent / f"{name}.json"), help="JSON file of settings")
    told = vars(parser.parse_args(given))
    settings = json.loads(Path(told.pop("config")).read_text(encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **told, **settings)
    finally:
        spark.stop()
