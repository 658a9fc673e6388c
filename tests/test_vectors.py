"""Vector search and embedding: exact vs brute force, LSH recall, embedding norms."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tickwise.operators import filings as fl
from tickwise.operators import vectors as vx
from tickwise.plans import views as V


def _brute(emb_rows, queries, k):
    out = {}
    for qid, qv in queries.items():
        q = np.asarray(qv, dtype=float)
        scores = []
        for vid, v in emb_rows:
            v = np.asarray(v, dtype=float)
            scores.append((-(v @ q) / (np.linalg.norm(v) * np.linalg.norm(q)), vid))
        out[qid] = [vid for _, vid in sorted(scores)[:k]]
    return out


def test_exact_search_matches_brute_force(spark):
    emb = V.read(spark, SF_CHECK, "embeddings")
    cen = vx.centroids(emb, "label", "embedding")
    queries = {r["label"]: r["embedding"] for r in cen.collect()}
    rows = [(r["vec_id"], r["embedding"]) for r in emb.collect()]
    got = vx.similarity_search(emb, cen, 5, "vec_id", "embedding", "label", "embedding").collect()
    by_q = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_q.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by_q == _brute(rows, queries, 5)


def test_self_queries_find_themselves_and_lsh_recall(spark):
    emb = V.read(spark, SF_CHECK, "embeddings")
    # self queries: a data-derived set of vectors (label 3) searched against the whole corpus
    queries = emb.where(F.col("label") == 3)
    exact = vx.similarity_search(emb, queries, 1, "vec_id", "embedding", "vec_id", "embedding").collect()
    assert all(r["vec_id"] == r["query_id"] for r in exact)
    approx = vx.similarity_search_lsh(emb, queries, 1, "vec_id", "embedding", "vec_id", "embedding",
                                      bucket_length=2.0, num_tables=6).collect()
    hits = sum(1 for r in approx if r["vec_id"] == r["query_id"])
    assert hits >= 0.9 * queries.count()


def test_embeddings_are_unit_length(spark):
    from pyspark.ml.functions import vector_to_array
    docs = V.filings(spark, SF_CHECK).select("chunk_id", "content").limit(50)
    e = fl.embed(docs, num_features=1 << 10).select(vector_to_array("embedding").alias("a"))
    norms = [math.sqrt(sum(x * x for x in r["a"])) for r in e.collect()]
    assert all(abs(n - 1.0) < 1e-9 or n == 0.0 for n in norms) and any(n > 0 for n in norms)


def test_null_and_odd_vectors_and_many_queries(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(100, None), (101, [1.0, None, 2.0]), (102, [1.0]),
                                                                          (103, [float("nan"), 1.0, 1.0]), (104, [0.0, 0.0, 0.0])]
    emb = spark.createDataFrame(rows, "id int, v array<double>")
    got = vx.similarity_search(emb, emb, 3, "id", "v", "id", "v", query_block=16).collect()
    per = {}
    for r in got:
        per.setdefault(r["query_id"], []).append(r["id"])
    assert set(per) == set(range(60)) | {102} and all(len(x) == 3 for q, x in per.items() if q < 60)
    assert per[102] == [102]
