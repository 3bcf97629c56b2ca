"""Vector search: top-k by cosine of a stated set of queries against all points, in blocks; late interaction; diversity.

Points and queries are hashed into blocks of bounded size, and every block of points meets every block of queries in one task: a matrix product, of which only the best k per query leave
it; the final top-k is over those. Nothing goes through the driver, and no side is broadcast. The work is that of all pairs, as brute force is. Null and zero vectors have
similarity 0; vectors of another length than the queries' are null. Ties are ordered by the point's id. Similarities are rounded to 6 places before they are ranked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import dot
from docloom.operators.lexical import top_per

#: Points and queries of one block, about: what one task holds.
POINT_BLOCK, QUERY_BLOCK = 32_768, 4_096


def _unit_rows(vectors: list, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[i] = v
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, lengths, out=out, where=lengths > 0)


def vector_topk(points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", exclude_self: bool = False) -> DataFrame:
    """(query, key, score, rank). `queries` has (query, vector)."""
    kind, query_kind = dict(points.dtypes)[key], dict(queries.dtypes)[query]
    asked = queries.where(F.col(vector).isNotNull())
    point_blocks, query_blocks = max(1, -(-points.count() // POINT_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), block(key, point_blocks).alias("_p"), every(query_blocks).alias("_q"))
    right = asked.select(F.col(query).alias("_query"), F.col(vector).alias("_vector"), every(point_blocks).alias("_p"), block(query, query_blocks).alias("_q"))
    columns = [query, key, "score"]

    def best(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(held):
            return pd.DataFrame({c: [] for c in columns})
        own = own.sort_values("_key", kind="stable")
        size = len(held["_vector"].iloc[0])
        keys, matrix = own["_key"].to_numpy(), _unit_rows(list(own["_vector"]), size)
        parts = []
        for at in range(0, len(held), 256):
            ids = held["_query"].to_numpy()[at : at + 256]
            scores = np.round(matrix @ _unit_rows(list(held["_vector"].iloc[at : at + 256]), size).T, 6)
            first = np.argsort(-scores, axis=0, kind="stable")[: k + 1]
            parts.append(pd.DataFrame({query: np.repeat(ids, len(first)), key: keys[first].T.ravel(), "score": np.take_along_axis(scores, first, 0).T.ravel()}))
        return pd.concat(parts)

    found = left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInPandas(best, f"{query} {query_kind}, {key} {kind}, score double")
    if exclude_self:
        found = found.where(F.col(query) != F.col(key))
    return top_per(found, query, [F.desc("score"), F.asc(key)], k)


def tokens_of(vector: Column, parts: int) -> Column:
    """A vector as several shorter ones: a stand-in for the token vectors of a late-interaction model."""
    size = (F.size(vector) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(vector, i * size + 1, size))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: of each query vector the best product with a document vector, summed."""
    return F.aggregate(query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(doc, lambda d: dot(q, d))))


def two_stage(points: DataFrame, queries: DataFrame, k: int, parts: int = 4) -> DataFrame:
    """The best 3k by cosine, of these the best k by late interaction."""
    first = vector_topk(points, queries, 3 * k).select("query_id", "vec_id")
    q = queries.select("query_id", tokens_of(F.col("embedding"), parts).alias("_q"))
    d = points.select("vec_id", tokens_of(F.col("embedding"), parts).alias("_d"))
    scored = first.join(d, "vec_id").join(q, "query_id").select("query_id", "vec_id", F.round(max_sim(F.col("_q"), F.col("_d")), 5).alias("score"))
    return top_per(scored, "query_id", [F.desc("score"), F.asc("vec_id")], k)


def mmr(candidates: DataFrame, k: int, weight: float = 0.7, query: str = "query_id", key: str = "vec_id", score: str = "score", vector: str = "embedding") -> DataFrame:
    """(query, key, pick): greedy selection by weight x relevance - (1 - weight) x the largest similarity to those picked. The candidates of a
    query are its top-k of an earlier stage, so a group is small by construction. A null vector has similarity 0 to all."""
    kinds = dict(candidates.dtypes)

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True])
        vectors = list(pdf[vector])
        size = max((len(v) for v in vectors if v is not None), default=1)
        unit = _unit_rows(vectors, size)
        similarity, relevance = unit @ unit.T, pdf[score].to_numpy(dtype=float)
        left, picked = list(range(len(pdf))), []
        while left and len(picked) < k:
            value = [round(weight * relevance[i] - (1 - weight) * (max(similarity[i][j] for j in picked) if picked else 0.0), 9) for i in left]
            picked.append(left.pop(int(np.argmax(value))))
        return pd.DataFrame({query: pdf[query].iloc[picked].to_numpy(), key: pdf[key].iloc[picked].to_numpy(), "pick": range(1, len(picked) + 1)})

    return candidates.select(query, key, score, vector).groupBy(query).applyInPandas(select, f"{query} {kinds[query]}, {key} {kinds[key]}, pick int")
