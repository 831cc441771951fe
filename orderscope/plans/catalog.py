"""Registry of every query: ``name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None)``.

Oracle SQL runs in DuckDB over the raw input tables; derived views are
inlined as CTEs so the oracle never depends on this package's outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures as FX
from . import analytics

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, fn: Query, sql: str | None) -> None:
    if name in REGISTRY:
        raise ValueError(f"duplicate query {name}")
    REGISTRY[name] = (fn, sql)


def with_cte(sql: str, **ctes: str) -> str:
    body = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
    s = sql.strip()
    if s.upper().startswith("WITH "):
        return f"WITH {body},\n{s[5:]}"
    return f"WITH {body}\n{s}"


def _analytics():
    for name, (fn, sql) in analytics.QUESTIONS.items():
        register(name, (lambda f: lambda spark, sf: f(FX.procurement(spark, sf)))(fn),
                 with_cte(sql, procurement=FX.PROCUREMENT_SQL) if sql else None)


def _load_all():
    if REGISTRY:
        return
    _analytics()
    from . import extra  # noqa: F401  (registers the non-analytic operators)
    extra.register_all(register, with_cte)


def queries() -> dict[str, Query]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
