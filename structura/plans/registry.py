"""The query registry: one entry per operator key of the blueprint.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with
the DuckDB SQL twin used as the correctness oracle (``None`` when the
operator cannot be said in SQL, e.g. the model call or the stream).
Modules register their queries with :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    fn: QueryFn
    sql: str | None


_REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        _REGISTRY[key] = Query(key, fn, sql)
        return fn
    return deco


def _load_all() -> None:
    from . import q_tree  # noqa: F401
    from . import q_sitemap  # noqa: F401
    from . import q_ingest  # noqa: F401
    from . import q_prompt  # noqa: F401
    from . import q_rules  # noqa: F401
    from . import q_stream  # noqa: F401


def all_queries() -> dict[str, Query]:
    if not _REGISTRY:
        _load_all()
    return dict(_REGISTRY)
