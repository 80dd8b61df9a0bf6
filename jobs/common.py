"""What the jobs share: configuration files and the log."""

from __future__ import annotations

import logging
import os
from dataclasses import fields
from typing import TypeVar

import yaml
from pyspark.sql import SparkSession

T = TypeVar("T")


def load_config(kind: type[T], path: str) -> T:
    """A config dataclass from a YAML file on the driver; unknown keys are errors, lists become tuples."""
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    unknown = set(found) - {x.name for x in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def default_config(kind: type[T], name: str) -> T:
    return load_config(kind, os.path.join(os.path.dirname(os.path.abspath(__file__)), name))


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
