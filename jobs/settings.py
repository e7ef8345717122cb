"""Settings of a job: a JSON file of a few names, read by Spark, so that it may lie anywhere."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession


def load(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with the file's values; other names and values of other types are errors."""
    if not path:
        return dict(defaults)
    given = json.loads(spark.read.text(path, wholetext=True).first().value)
    for name, value in given.items():
        if name not in defaults:
            raise ValueError(f"unknown setting: {name}")
        if type(value) is not type(defaults[name]):
            raise ValueError(f"{name} must be of type {type(defaults[name]).__name__}")
    return defaults | given


def beside(module: str) -> str:
    """The settings file that lies beside a job's module."""
    return Path(module).with_suffix(".json").resolve().as_uri()


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
