import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.tokens import default_vocabulary, encode_corpus, encoder, merge_long, merge_short


def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(default_vocabulary(), "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


RANKS, REFERENCE = reference()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_the_public_encoder_and_decodes(text):
    ids = encoder(default_vocabulary(), public_tokenizers.PATTERN)(text)
    assert ids == REFERENCE.encode_ordinary(text) and REFERENCE.decode_bytes(ids) == text.encode("utf-8", "surrogatepass")


def test_scanning_and_heap_make_the_same_merges():
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdeetaoin \xc3\xa9\xe6\xbc") for _ in range(rng.randint(1, 300)))
        assert merge_short(word, RANKS) == merge_long(word, RANKS)


def test_corpus(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "ab" * 60000), (1, "hello world")]
    got = [(r.doc_id, list(r.ids)) for r in encode_corpus(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()]
    assert sorted(got) == sorted((i, REFERENCE.encode_ordinary(t or "")) for i, t in rows)
    assert all(i != 50256 for _, ids in got for i in ids)
