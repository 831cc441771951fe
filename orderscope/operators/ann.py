"""Many-query search and the inverted file under their earlier names, recall, and the 2-D projection.

The work is in ``vector_blocks``: exact search scores pairs of blocks without the driver, the index reads probed
lists only.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import vector_blocks as VB


def batch_vector_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id",
                      vec_col: str = "embedding", qid: str = "query_id", qvec: str = "embedding") -> DataFrame:
    """R9 (vector part): exact cosine top-k for every query; (query_id, id, score, rank)."""
    return VB.block_pair_topk(corpus, queries, k, id_col, vec_col, qid, qvec)


def ivf_build(corpus: DataFrame, nlist: int, id_col: str = "doc_id", vec_col: str = "embedding",
              seed: int = 1) -> tuple[VB.InvertedFile, np.ndarray]:
    index = VB.build(corpus, nlist, id_col, vec_col, seed)
    return index, index.centroids


def ivf_search(index: VB.InvertedFile, centroids: np.ndarray, queries: DataFrame, k: int, nprobe: int,
               qid: str = "query_id", qvec: str = "embedding") -> DataFrame:
    return VB.search(index, queries, k, nprobe, qid, qvec)


def materialize_once(df: DataFrame) -> DataFrame:
    """Write a result reused by several plans (here: exact neighbours) to the shared folder once."""
    path = shared_dir(df.sparkSession, "ann", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def recall_at_k(exact: DataFrame, approx: DataFrame, k: int, qid: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    hit = exact.select(qid, id_col).join(approx.select(qid, id_col), [qid, id_col])
    per_q = exact.select(qid).distinct().join(hit.groupBy(qid).agg(F.count(F.lit(1)).alias("h")), qid, "left")
    return per_q.agg(F.avg(F.coalesce(F.col("h"), F.lit(0)) / F.lit(float(k))).alias("recall"))


# --------------------------------------------------------------------------- 2-D projection

def project_2d(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """PCA(k=2) of the vectors (the seed of the original t-SNE)."""
    feats = df.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_f"))
    model = PCA(k=2, inputCol="_f", outputCol="_p").fit(feats)
    arr = vector_to_array(F.col("_p"))
    return model.transform(feats).select(id_col, arr[0].alias("x"), arr[1].alias("y"))
