"""What the jobs' command lines and queries share."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from tessera.sources.scratch import shared_dir

LOG = logging.getLogger("jobs")


def settings(path: str, known: dict) -> dict:
    """`known` overlaid by the JSON object in the file; a name that isn't known is an error."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    if odd := set(given) - set(known):
        raise ValueError(f"{path} has settings that the job doesn't know: {sorted(odd)}")
    return known | given


def command_line(what: str, arguments: Sequence[str], config: str, known: dict, run: Callable[..., dict]) -> None:
    """Parse plain paths and the config file, start a session, run the job, stop the session."""
    parser = argparse.ArgumentParser(description=what)
    parser.add_argument("--config", default=config, help="a JSON file of settings")
    for name in arguments:
        parser.add_argument(f"--{name}", required=True)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    chosen = settings(given.pop("config"), known)
    spark = SparkSession.builder.appName(os.path.basename(sys.argv[0])).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(run(spark, **given, settings=chosen)))
    finally:
        spark.stop()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the folder that driver and executors share; what is written there stays."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
