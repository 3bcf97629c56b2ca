"""Evaluation texts leaking into training text (problem 8).

Words are maximal runs of letters and digits in lower case. Seeds join documents to items. Every n-gram of an item is a
seed, so a pair that shares one is aligned, however many documents hold it and however the copy has been edited. Where only
passages of `run` words are asked for, the seeds are fewer: of every window of `run` words whose n-grams all occur, the one
of the least document frequency; any such passage holds a seed, and no pair is lost, however common its words are. Each pair
found is aligned word by word with Smith-Waterman (match 2, mismatch -1, gap -1); the score shows edited and paraphrased
copies, and the longest exact run on a diagonal of the same table decides what counts as a passage.

Scale: documents are cut into n-grams once, narrowly; of these only the ones that some item holds go further, and that small
table gives frequencies, seeds and pairs. The alignment reads the documents once more; tables of many pairs are filled at the
same time. Frequencies are partial sums before the shuffle, so a frequent n-gram is no hot key.
Evaluation items, their n-grams, the seeds and the pairs are broadcast only after their bytes have been measured; beyond the
bound the same joins run with a shuffle.

Cases: null or empty texts have no words and leak nothing; items of fewer than `n` words have no n-gram and are in no
pair; repeated rows come out once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import broadcast_checked, cut

MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of the tables that are filled at the same time.
CELLS = 1 << 16

_WORD = re.compile(r"[^\W_]+")


def cut_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """The hash of each word, computed once per batch."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def gram_hashes(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the hashes of its word n-grams, in order; equal n-grams have equal hashes."""
    known = _Hashes()
    hashes = [[known[w] for w in cut_words(t)] for t in texts]
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    flat = np.array([x for h in hashes for x in h], dtype=np.uint64)
    if len(flat) < n:
        return [np.empty(0, dtype=np.int64) for _ in texts]
    count = len(flat) - n + 1
    grams = flat[:count].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            grams *= np.uint64(0x9E3779B97F4A7C15)
            grams += flat[k : k + count]
        grams ^= grams >> np.uint64(29)
    grams = grams.view(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return [grams[s : s + max(0, size - n + 1)] for s, size in zip(starts, sizes)]


def _grams(n: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def grams(texts: pa.Array) -> pa.Array:
        found = gram_hashes(texts.to_pylist(), n)
        offsets = np.concatenate(([0], np.cumsum([len(g) for g in found]))).astype(np.int32)
        values = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int64()))

    return grams.asNondeterministic()  # for the planner only, which would else compute them once more to drop empty arrays


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The Smith-Waterman score of each pair (document, item) of word numbers, and its longest common run. Pairs of like length are
    aligned together: one step fills one item word's row of all their tables."""
    score, longest = np.zeros(len(pairs), dtype=np.int32), np.zeros(len(pairs), dtype=np.int32)
    order = sorted((i for i, (d, w) in enumerate(pairs) if len(d) and len(w)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        end, width = at + 1, len(pairs[order[at]][0])
        while end < len(order) and (end - at + 1) * max(width, len(pairs[order[end]][0])) <= CELLS:
            width = max(width, len(pairs[order[end]][0]))
            end += 1
        own, at = order[at:end], end
        docs = np.full((len(own), width), -1, dtype=np.int32)
        items = np.full((len(own), max(len(pairs[i][1]) for i in own)), -2, dtype=np.int32)
        for row, i in enumerate(own):
            docs[row, : len(pairs[i][0])], items[row, : len(pairs[i][1])] = pairs[i]
        # Small numbers where the scores fit in them: the tables are read and written as often as an item has words.
        kind = np.int16 if 2 * MATCH * items.shape[1] + width < 32_000 else np.int32
        ramp = np.arange(width, dtype=kind) * kind(-GAP)
        table, run = np.zeros((len(own), width + 1), dtype=kind), np.zeros((len(own), width + 1), dtype=kind)
        reach, down, gain = (np.empty((len(own), width), dtype=t) for t in (kind, kind, np.int8))
        best, most = np.zeros((len(own), width), dtype=kind), np.zeros((len(own), width), dtype=kind)
        for k in range(items.shape[1]):
            same = (docs == items[:, k : k + 1]).view(np.int8)
            np.multiply(same, np.int8(MATCH - MISMATCH), out=gain)
            gain += np.int8(MISMATCH)
            np.add(table[:, :-1], gain, out=reach)
            np.add(table[:, 1:], kind(GAP), out=down)
            np.maximum(reach, down, out=reach)
            np.maximum(reach, 0, out=reach)
            np.maximum(best, reach, out=best)  # a gap never raises the best score
            reach += ramp
            np.maximum.accumulate(reach, axis=1, out=reach)  # gaps along the document
            np.subtract(reach, ramp, out=table[:, 1:])
            np.add(run[:, :-1], kind(1), out=down)
            np.multiply(down, same, out=run[:, 1:])
            np.maximum(most, run[:, 1:], out=most)
        score[own], longest[own] = best.max(axis=1), most.max(axis=1)
    return score, longest


def align(doc: list[str], item: list[str]) -> tuple[float, int]:
    """The score of two word lists and their longest common run."""
    numbers: dict[str, int] = {}
    a, b = (np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int32) for words in (doc, item))
    score, longest = align_many([(a, b)])
    return float(score[0]), int(longest[0])


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        numbers: dict[str, int] = {}
        known: dict[str, np.ndarray] = {}

        def numbered(text: str) -> np.ndarray:
            if text not in known:
                known[text] = np.array([numbers.setdefault(w, len(numbers)) for w in cut_words(text)], dtype=np.int32)
            return known[text]

        pairs = [(numbered(d), numbered(i)) for d, i in zip(batch["_text"], batch["_item_text"])]
        score, longest = align_many(pairs)
        out = batch[["_doc", "_item"]].copy()
        out["score"], out["longest_run"] = score.astype(float), longest.astype("int64")
        out["similarity"] = score / (MATCH * np.array([max(1, len(i)) for _, i in pairs]))
        yield out


def leak_candidates(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str, n: int = 5, run: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(_doc, _item) pairs that share a seed, and the items with their texts. Without `run` these are all pairs that share an
    n-gram; with it, all that share a passage of `run` words, and others by chance."""
    texts = items.select(F.col(item).alias("_item"), F.col(text).alias("_item_text")).where(F.col("_item_text").isNotNull()).distinct()
    texts = broadcast_checked(cut(texts))
    grams = cut(texts.select("_item", F.posexplode(_grams(n)("_item_text")).alias("_pos", "_gram")))
    distinct = broadcast_checked(cut(grams.select("_gram").distinct()))
    corpus = docs.select(F.col(doc).alias("_doc"), _grams(n)(F.col(text)).alias("_grams"))
    # The n-grams that both sides hold: all that the following steps need of the corpus.
    found = cut(corpus.select("_doc", F.explode("_grams").alias("_gram")).join(distinct, "_gram", "left_semi").distinct())
    seeds = grams.select("_item", "_gram").distinct() if run is None else _rarest(grams, found, n, run)
    pairs = found.join(broadcast_checked(cut(seeds)), "_gram").select("_doc", "_item").distinct()
    return pairs, texts


def _rarest(grams: DataFrame, found: DataFrame, n: int, run: int) -> DataFrame:
    """(_item, _gram): the rarest n-gram of every window of `run` words. Only n-grams that occur have a frequency: a window with
    one that doesn't is in no document as a whole and needs no seed."""
    frequency = found.groupBy("_gram").agg(F.count("*").alias("_df"))
    windows = F.sequence(F.greatest(F.lit(0), F.col("_pos") - (run - n)), F.col("_pos"))
    return (
        grams.join(frequency, "_gram")
        .select("_item", F.explode(windows).alias("_window"), F.struct("_df", "_pos", "_gram").alias("_own"))
        .groupBy("_item", "_window")
        .agg(F.min("_own").alias("_rarest"), F.count("*").alias("_occurring"))
        .where(F.col("_occurring") == run - n + 1)
        .select("_item", F.col("_rarest._gram").alias("_gram"))
        .distinct()
    )


def leaks(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str, n: int = 5, run: int | None = None) -> DataFrame:
    """(doc, item, score, similarity, longest_run) of every document and item that share an n-gram; with `run`, of those at least
    that share a passage of so many words. Similarity is the score
    over that of the whole item, 1 for an unchanged copy; longest_run is the longest exact passage in words."""
    pairs, texts = leak_candidates(docs, items, doc, item, text, n, run)
    pairs = broadcast_checked(cut(pairs))
    matched = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(pairs, "_doc").join(texts, "_item").select("_doc", "_item", "_text", "_item_text")
    kinds = dict(matched.dtypes)
    scored = matched.mapInPandas(_aligned, f"_doc {kinds['_doc']}, _item {kinds['_item']}, score double, longest_run long, similarity double")
    best = scored.groupBy("_doc", "_item").agg(*(F.max(c).alias(c) for c in ("score", "similarity", "longest_run")))
    return best.select(F.col("_doc").alias(doc), F.col("_item").alias(item), "score", "similarity", "longest_run")
