"""Hooks for models: embedding, recognition, reranking, conversion of files. Each takes a function of plain Python values and runs it in Arrow batches; each has a deterministic
stand-in, because no weights come with the engine.

A model is loaded once for each worker process: what is given is a function without arguments that returns the model, called at the first batch. Null texts give null vectors, no finds and no
relevance. A model that fails on a batch gives none for it, and the stages go on without: no vector, no finds, the direct score."""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import segments as S

# What stands before texts of either kind for models that are told.
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
_TOKEN = re.compile(r"\w+")


class HashedTokens:
    """The stand-in for an embedding model: tokens hashed to places of a vector of unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = np.zeros(self.size, dtype=np.float32)
            for token in _TOKEN.findall(text.lower()):
                digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
                vector[int.from_bytes(digest[:4], "big") % self.size] += 1.0 if digest[4] & 1 else -1.0
            length = float(np.linalg.norm(vector))
            out.append((vector / length if length else vector).tolist())
        return out


def _batched(model: Callable, values: list):
    """The model's answers; none where it fails."""
    try:
        return list(model(values))
    except Exception:
        logging.getLogger(__name__).warning("the model failed on a batch of %d", len(values), exc_info=True)
        return [None] * len(values)


def embedded(texts: DataFrame, text: str, out: str = "embedding", load: Callable[[], Callable[[list[str]], list[list[float]]]] = HashedTokens, prefix: str = DOCUMENT_PREFIX) -> DataFrame:
    """The frame with the vector of each text; `prefix` is put before it, for questions QUERY_PREFIX."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            given = batch.notna()
            vectors = iter(_batched(model, [prefix + t for t in batch[given]]))
            yield pd.Series([next(vectors) if ok else None for ok in given], dtype="object", index=batch.index)

    return texts.withColumn(out, F.pandas_udf(embed, "array<float>")(F.col(text)))


def token_vectors(texts: DataFrame, text: str, out: str = "token_vectors", load: Callable = HashedTokens) -> DataFrame:
    """The frame with one vector for each token of each text, for late interaction."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([None if t is None else _batched(model, _TOKEN.findall(t)) for t in batch], dtype="object")

    return texts.withColumn(out, F.pandas_udf(embed, "array<array<float>>")(F.col(text)))


def recognised(texts: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]], chars: int = 500) -> DataFrame:
    """(key, name, label, raw): what a recognition model finds in the windows of each text, of one name and label the first. The model takes windows and gives the texts and labels found
    in each."""
    rows = texts.select(key, F.posexplode(S.windows(text, chars)).alias("n", "window"))
    kind = dict(texts.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            found = _batched(model, list(batch["window"]))
            yield pd.DataFrame([(k, int(n), i, " ".join(raw.lower().split()), label, raw) for k, n, own in zip(batch[key], batch["n"], found) for i, (raw, label) in enumerate(own or [])], columns=[key, "n", "i", "name", "label", "raw"])

    rows = rows.mapInPandas(find, f"{key} {kind}, n int, i int, name string, label string, raw string")
    return rows.groupBy(key, "name", "label").agg(F.min_by("raw", F.struct("n", "i")).alias("raw"))


def scorer(load: Callable[[], Callable[[str, list[str]], list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """A scorer for `reranked`: the model takes a question and the texts of its candidates, of which there are at most as many as the routed limits allow, and gives their relevance."""

    def score(pairs: DataFrame) -> DataFrame:
        kinds = dict(pairs.dtypes)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk_id")
            values = _batched(lambda texts: load()(pdf["question"].iloc[0], texts), [t or "" for t in pdf["content"]])
            return pd.DataFrame({"query_id": pdf["query_id"].to_numpy(), "chunk_id": pdf["chunk_id"].to_numpy(), "relevance": pd.array(values, dtype="Float64")})

        return pairs.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, relevance double")

    return score


def converted(units: DataFrame, load: Callable[[bool], Callable[[bytes], list[str]]], has_images: Callable[[bytes], bool] | None = None) -> DataFrame:
    """(book_id, start_offset, page_in_unit, text) of units (book_id, start_offset, content as bytes, ocr): the pages that a converter makes of each. The converter with recognition of
    scanned text is used only where it is asked for and the unit has an image; where that can't be told it is used."""
    probe = has_images or (lambda _: True)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[bool, Callable] = {}
        for batch in batches:
            rows = []
            for book, offset, content, ocr in zip(batch["book_id"], batch["start_offset"], batch["content"], batch["ocr"]):
                try:
                    scanned = bool(ocr) and bool(probe(bytes(content)))
                except Exception:
                    scanned = bool(ocr)
                model = models.setdefault(scanned, load(scanned)) if scanned not in models else models[scanned]
                rows += [(book, offset, i, text) for i, text in enumerate(model(bytes(content)))]
            yield pd.DataFrame(rows, columns=["book_id", "start_offset", "page_in_unit", "text"])

    return units.select("book_id", "start_offset", "content", "ocr").mapInPandas(convert, "book_id string, start_offset int, page_in_unit int, text string")
