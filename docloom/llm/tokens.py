"""Encoding a corpus with a public byte-level BPE vocabulary (problem 7).

The vocabulary is read from a file of ranks, whose path is a parameter; nothing is trained. Each text is cut into words by
the vocabulary's pattern. A word that is itself in the vocabulary is one token. Any other is merged with a contiguous rank
array: it holds the part boundaries and, beside each, the rank of the pair that begins there; the minimum is looked for by
scanning, its boundary deleted and the ranks of the two neighbours refreshed. Scanning is quadratic in the length of the
word, so words of more than `SHORT_BYTES` bytes use a heap over a linked list, which makes the same merges.

Null and empty texts give an empty list. No special tokens are added; their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of at most so many bytes are merged by scanning.
SHORT_BYTES = 128
#: A worker remembers the ids of so many words at most, and begins anew when they are full.
CACHE_WORDS = 200_000

_NONE = 1 << 60


def default_vocabulary() -> str:
    """Where the public vocabulary byte_bpe_50k lies as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word, by scanning a contiguous array of boundaries and ranks."""
    size = len(word)
    starts = list(range(size + 1))
    rank = [ranks.get(word[i : i + 2], _NONE) for i in range(size - 1)]
    rank += [_NONE, _NONE]
    while True:
        low = min(rank)
        if low == _NONE:
            break
        i = rank.index(low)
        del starts[i + 1], rank[i + 1]
        n = len(starts)
        rank[i] = ranks.get(word[starts[i] : starts[i + 2]], _NONE) if i + 2 < n else _NONE
        if i:
            rank[i - 1] = ranks.get(word[starts[i - 1] : starts[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, with a heap over linked parts: n log n."""
    size = len(word)
    ends = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    alive = [True] * size
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= size or ends[ends[i]] != end:
            continue  # one of the two parts has been merged since
        middle = ends[i]
        alive[middle] = False
        ends[i] = end
        if end < size:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    ids, i = [], 0
    while i < size:
        ids.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Callable[[str | None], list[int]]:
    """A function from a text to its ids; one for each Python worker."""
    import regex

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    words = regex.compile(pattern).findall
    known: dict[str, list[int]] = {}

    def encode(text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        for word in words(text):
            own = known.get(word)
            if own is None:
                raw = word.encode("utf-8", "surrogatepass")
                whole = ranks.get(raw)
                own = [whole] if whole is not None else merge_short(raw, ranks) if len(raw) <= SHORT_BYTES else merge_long(raw, ranks)
                if len(raw) <= SHORT_BYTES:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = own
            ids += own
        return ids

    return encode


def token_ids(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The token ids of a text as an array of integers, never null."""
    if path is None:
        path = default_vocabulary()
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path, pattern)
        for batch in batches:
            yield batch.map(encode, na_action=None)

    return ids(F.coalesce(text, F.lit("")))


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """Key and ids of every row; a narrow pass over the two columns, without a shuffle. Repeated rows stay repeated."""
    return df.select(key, token_ids(F.col(text), path).alias("ids"))
