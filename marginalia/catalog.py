"""All queries of the library by name, with the SQL that says the same."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from . import plans
from .registry import ORACLES, QUERIES, Query

for _m in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_m.name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["find_all_hits"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
