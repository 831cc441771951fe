"""User-facing entry points mirroring the original service surfaces.

``Engine`` holds the allow-listed tables (DataFrames) and offers the same
calls the original API/tool server offered, each returning a DataFrame (or a
``QueryResult`` for SQL):

* ``run_sql(sql, params, limit)``                  guarded read-only SQL
* ``semantic_search(query_text | order_code, top_k, **filters)``
* ``semantic_search_commesse(query_text | commessa_code, top_k, **filters)``
* ``search(query, top_k, alpha)``                   hybrid BM25 + vector over a corpus
* ``list_schema()``                                 (table, column, description)

Query texts are normalised and embedded with ``embedder`` (a callable
``list[str] -> ndarray``; default: the offline hashed bag-of-words model) —
the same model that must have produced the stored vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import bm25 as B
from ..operators import enrich as EN
from ..operators import filters as FL
from ..operators import hybrid as H
from ..operators import vector_search as VS
from ..sources.schema import combined_columns, described, schema_catalog
from .sqlguard import QueryResult, SqlGuard


class Engine:
    def __init__(self, spark: SparkSession, orders: DataFrame, commesse: DataFrame | None = None,
                 corpus: H.Corpus | None = None, embedder: Callable[[list[str]], np.ndarray] | None = None,
                 dim: int = C.EMBED_OUTPUT_DIM):
        self.spark = spark
        self.orders = orders
        self.commesse = commesse
        self.corpus = corpus
        self.embedder = embedder
        self.dim = dim
        tables = {"orders": lambda s: orders}
        if commesse is not None:
            tables["commesse"] = lambda s: commesse
        self._guard = SqlGuard(spark, tables)

    # -- SQL -------------------------------------------------------------------
    def run_sql(self, sql: str, params: dict[str, Any] | None = None, limit: int | None = None,
                dataset: str | None = None) -> QueryResult:
        return self._guard.run(sql, params=params, limit=limit, dataset=dataset)

    # -- vectors ---------------------------------------------------------------
    def _text_vector(self, text: str):
        return VS.query_vector(EN.text_vector(self.spark, text, self.dim, self.embedder), "embedding")

    def semantic_search(self, query_text: str | None = None, order_code: str | None = None,
                        top_k: int = C.SEMANTIC_TOP_K, **filters) -> DataFrame:
        if not query_text and not order_code:
            raise ValueError("Provide query_text or order_code.")
        k = FL.check_top_k(top_k)
        f = FL.normalize_filter_args(filters, "orders")
        if order_code:
            q = VS.query_vector(FL.lookup_code(self.orders, order_code), "summary_embedding")
        else:
            q = self._text_vector(query_text)
        return VS.semantic_orders(self.orders, q, k, f)

    def semantic_search_commesse(self, query_text: str | None = None, commessa_code: str | None = None,
                                 top_k: int = C.SEMANTIC_TOP_K, **filters) -> DataFrame:
        if self.commesse is None:
            raise ValueError("no commesse table configured")
        if not query_text and not commessa_code:
            raise ValueError("Provide query_text or commessa_code.")
        k = FL.check_top_k(top_k)
        f = FL.normalize_filter_args(filters, "commesse")
        if commessa_code:
            q = VS.query_vector(FL.lookup_code(self.commesse, commessa_code, "commessa_code"), "oggetto_embedding")
        else:
            q = self._text_vector(query_text)
        return VS.semantic_commesse(self.commesse, q, k, f)

    # -- hybrid ----------------------------------------------------------------
    def search(self, query: str, top_k: int = C.DEFAULT_TOP_K, alpha: float = C.DEFAULT_ALPHA) -> DataFrame:
        if self.corpus is None:
            raise ValueError("no retrieval corpus configured")
        k = FL.check_top_k(top_k, C.DEFAULT_TOP_K)
        qdf = self.spark.createDataFrame([(query,)], "text string")
        return H.hybrid_hits(self.corpus, B.query_terms(qdf), self._text_vector(query), k, alpha)

    # -- schema ----------------------------------------------------------------
    def _tables(self) -> dict[str, DataFrame]:
        return {"orders": self.orders} | ({"commesse": self.commesse} if self.commesse is not None else {})

    def list_schema(self) -> DataFrame:
        """Columns with their descriptions: those stored with the tables, else the known ones."""
        return schema_catalog(self.spark, {name: df if any(f.metadata.get("comment") for f in df.schema.fields) else described(df, name) for name, df in self._tables().items()})

    def columns(self) -> list[str]:
        """The columns of all tables, each once, in order."""
        return combined_columns(self._tables())
