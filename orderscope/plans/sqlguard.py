"""Guarded read-only SQL (H1–H3, F3, G2) on Spark SQL.

The guard runs in its own session (``spark.newSession()``) in which only the
allow-listed tables exist, as temporary views, the current database is an
empty one, and ``spark.sql.runSQLOnFiles`` is off (no ``parquet.`/path```
tables). Checks, in order:

1. trim, strip trailing ``;`` — must start with SELECT or WITH;
2. mutating verbs as whole words (``created_at`` is a fine column name);
3. the text is wrapped as ``SELECT * FROM (<sql>) LIMIT n``: DDL, DML and
   multi-statement input become parse errors there;
4. the parsed plan (``EXPLAIN EXTENDED``) is read: every relation must be a
   single-part allow-listed name or a CTE name; ``IDENTIFIER(...)`` and the
   reflection functions are refused; the analysed plan must not touch a
   catalog table;
5. LIMIT policy: the first ``LIMIT n`` found decides — above the maximum all
   LIMITs are cut to the maximum (warning); none → the default is added
   (warning). The outer wrap never exceeds the maximum.

Execution is plain ``spark.sql(wrapped, args=params)`` with named ``:p``
parameters, so Catalyst/AQE plan it like any other query.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

_REFLECT = ("reflect", "java_method", "try_reflect")


@dataclass
class QueryResult:
    sql: str
    df: DataFrame
    warnings: list[str] = field(default_factory=list)

    def rows(self) -> list[dict]:
        """Rows with decimals as float, dates as ISO strings, arrays as lists."""
        return [serialize_row(r.asDict(recursive=True)) for r in self.df.collect()]


def serialize_row(row: dict) -> dict:
    import datetime
    import decimal
    out = {}
    for k, v in row.items():
        if isinstance(v, decimal.Decimal):
            v = float(v)
        elif isinstance(v, (datetime.date, datetime.datetime)):
            v = v.isoformat()
        out[k] = v
    return out


def serialize_columns(df: DataFrame) -> DataFrame:
    """A9 as a DataFrame transform: decimal → double, date/timestamp → ISO text."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t == "decimal":
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif t == "date":
            cols.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        elif t.startswith("timestamp"):
            cols.append(F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


_WRITES = re.compile("Insert|Create|Replace|Drop|Alter|Delete|Update|Merge|Truncate|Command|SetCatalog|Overwrite|Append")


def _scala(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def plan_nodes(plan):
    """Every node of a parsed plan: children, common table expressions and subqueries in expressions."""
    yield plan
    for more in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _scala(more):
            if hasattr(child, "nodeName"):
                yield from plan_nodes(child)


def tables_of(plan, bound: frozenset = frozenset()):
    """Names (as lists of parts, lower case) of the relations that a parsed plan reads; a name that a common table
    expression in scope gives is none of them."""
    if plan.nodeName() == "UnresolvedWith":
        for r in _scala(plan.cteRelations()):
            yield from tables_of(r._2(), bound)
            bound = bound | {r._1().lower()}
        yield from tables_of(plan.child(), bound)
        return
    if plan.nodeName() == "UnresolvedRelation":
        parts = [x.lower() for x in _scala(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in bound:
            yield parts
    for more in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _scala(more):
            if hasattr(child, "nodeName"):
                yield from tables_of(child, bound)


def outer_limit(plan, params: dict | None = None) -> int | None:
    """The LIMIT of the whole statement, a constant or a parameter; limits of inner queries and literals do not count."""
    while plan.nodeName() == "UnresolvedWith":
        plan = plan.child()
    if plan.nodeName() != "GlobalLimit":
        return None
    limit = plan.limitExpr()
    if limit.nodeName() == "NamedParameter":
        given = (params or {}).get(limit.name())
        return int(given) if isinstance(given, int) and not isinstance(given, bool) and given >= 0 else None
    return int(limit.toString()) if limit.toString().isdigit() else None


def limit_policy(plan, default_limit: int, max_limit: int, params: dict | None = None) -> tuple[list[str], int]:
    """(warnings, row bound put around the statement). The text itself is never changed."""
    asked = outer_limit(plan, params)
    if asked is None:
        return [f"Added default LIMIT {default_limit}"], default_limit
    if asked > max_limit:
        return [f"LIMIT reduced from {asked} to {max_limit}"], max_limit
    return [], max_limit


class SqlGuard:
    def __init__(self, spark: SparkSession, tables: dict[str, Callable[[SparkSession], DataFrame]],
                 default_limit: int = C.SQL_DEFAULT_LIMIT, max_limit: int = C.SQL_MAX_LIMIT):
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.allowed = {t.lower() for t in tables}
        for name, build in tables.items():
            df = build(self.session)
            if df.sparkSession._jsparkSession.equals(self.session._jsparkSession):
                df.createOrReplaceTempView(name)
            else:
                # a frame of the caller's session: share it through a uniquely named global
                # temp view and alias it under the plain name inside the guard session
                shared = f"orderscope_guard_{uuid.uuid4().hex[:12]}_{name}"
                df.createOrReplaceGlobalTempView(shared)
                self.session.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM global_temp.{shared}")
        self.default_limit = default_limit
        self.max_limit = max_limit

    # -- checks --------------------------------------------------------------
    def _parsed(self, sql: str):
        """The statement without its last semicolon, and its parsed plan; anything but a query is refused."""
        cleaned = sql.strip().rstrip(";").strip()
        first = re.match(r"\w*", cleaned).group().lower()
        if first not in ("select", "with"):
            raise ValueError("Only SELECT or WITH queries are allowed.")
        try:
            plan = self.session._jsparkSession.sessionState().sqlParser().parsePlan(cleaned)
        except Exception as e:  # noqa: BLE001 - several statements, syntax errors
            raise ValueError(f"Query rejected: {str(e).splitlines()[0][:300]}") from None
        for node in plan_nodes(plan):
            if _WRITES.search(node.nodeName()):
                raise ValueError("Mutating SQL statements are not allowed.")
        return cleaned, plan

    def _plan_check(self, wrapped: str, plan, params: dict | None) -> set[str]:
        """Refuse everything outside the allow-list; returns the allowed tables that the parsed plan names."""
        try:
            text = self.session.sql("EXPLAIN EXTENDED " + wrapped, args=params or None).first()[0]
        except Exception as e:  # parse errors: DDL, DML, several statements
            raise ValueError(f"Query rejected: {str(e).splitlines()[0][:300]}") from None
        parsed = text.split("== Analyzed Logical Plan ==")[0]
        analyzed = text.split("== Analyzed Logical Plan ==")[-1].split("== Optimized Logical Plan ==")[0]
        if "UnresolvedIdentifier" in parsed or re.search(r"\bidentifier\s*\(", wrapped, re.IGNORECASE):
            raise ValueError("IDENTIFIER() table references are not allowed.")
        for fn in _REFLECT:
            if re.search(rf"'{fn}\(", parsed, re.IGNORECASE):
                raise ValueError(f"Function {fn} is not allowed.")
        names = list(tables_of(plan))
        bad = {".".join(n) for n in names if len(n) != 1 or n[0] not in self.allowed}
        if bad:
            raise ValueError(f"Query references tables outside allowlist: {sorted(bad)}")
        if "AnalysisException" in analyzed:
            raise ValueError(f"Query rejected: {analyzed.strip().splitlines()[0][:300]}")
        if re.search(r"SubqueryAlias spark_catalog\.", analyzed):
            raise ValueError("Query references a catalog table outside the allowlist.")
        return {n[0] for n in names}

    # -- entry points ---------------------------------------------------------
    def enforce(self, sql: str, limit: int | None = None, params: dict[str, Any] | None = None) -> tuple[str, list[str], int]:
        """H1: the statement, warnings and its row bound."""
        cleaned, plan = self._parsed(sql)
        return cleaned, *limit_policy(plan, min(limit or self.default_limit, self.max_limit), self.max_limit, params)

    def run(self, sql: str, params: dict[str, Any] | None = None, limit: int | None = None,
            dataset: str | None = None) -> QueryResult:
        """H2 (+H3 when ``dataset`` is given: the parsed plan must read that table)."""
        cleaned, warnings, outer = self.enforce(sql, limit, params)
        wrapped = f"SELECT * FROM (\n{cleaned}\n) LIMIT {outer}"
        read = self._plan_check(wrapped, self._parsed(sql)[1], params)
        if dataset and dataset.lower() not in read:
            raise ValueError(f"Query must target the {dataset} table.")
        return QueryResult(cleaned, self.session.sql(wrapped, args=params or None), warnings)
