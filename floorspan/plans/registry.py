"""The register of queries: a name, the inventory rows that it covers, the plan and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from floorspan.plans.views import frame, with_views


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(rows: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register a plan that takes the named views as DataFrames; ``sql`` continues after their definitions.

    A plan that takes no views is given (spark, sf_dir).
    """
    names = views.split()

    def add(f: Callable[..., DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[frame(spark, sf_dir, n) for n in names]) if names else f(spark, sf_dir)

        text = None
        if sql is not None:
            head, body = with_views(*names, recursive=recursive), sql.strip()
            if body.startswith("+"):  # further expressions follow the views
                text = head + (", " if "AS (" in head else "") + body[1:]
                text = text if text.startswith("WITH") else f"WITH {text}"
            else:
                text = f"{head} {body}"
        name = f.__name__
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, tuple(rows.split()), build, text)
        return f

    return add
