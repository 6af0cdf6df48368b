import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import bpe
from tarnwell.llm.common import text_slices
from tarnwell.llm.pretoken import cut

from .cases import DOCS, docs, twins

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = ["'", "s", "'s", "'re", "'ll", "ve", "d", " ", "  ", "\n", "\r\n", "\t", "a", "Z", "é", "1", "½", "!", "-", "\u00a0", "\u3000", "😀", "漢", "x\u0301", "the", " the"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=5))
def test_cut_equals_pattern(texts):
    for s in text_slices(pa.array(texts, pa.string())):
        pieces, raw = cut(s.data, s.offsets), s.data.tobytes()
        for k, text in enumerate(texts[s.first : s.last]):
            at = slice(pieces.bounds[k], pieces.bounds[k + 1])
            assert [raw[a:b].decode() for a, b in zip(pieces.start[at], pieces.end[at], strict=True)] == regex.findall(P.PATTERN, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encode_equals_library(codec, text):
    (s,) = text_slices(pa.array([text], pa.string()))
    ids, bounds = codec.pieces.ids_of(s)
    assert ids.tolist() == LIBRARY.encode_ordinary(text) and bounds.tolist() == [0, len(ids)]
    assert codec.decode(ids, bounds)[0].tobytes() == text.encode()


def test_long_pieces(codec):
    rng = random.Random(3)
    for text in ("a" * 3000, "ab" * 2000, "".join(rng.choice("aabcdehitèßкот漢") for _ in range(3000))):
        (s,) = text_slices(pa.array([text]))
        assert codec.pieces.ids_of(s)[0].tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(["a", "ab", "-=", "abcdehitèßкот漢", "的一是不了人我在有他这为之大来以个中上们", "=#", "the"]), st.integers(65, 3000), st.randoms(use_true_random=False))
def test_stretches_equal_library(codec, letters, length, rng):
    """Runs of few characters, where no stretch finds its tokens, and of many."""
    texts = ["".join(rng.choice(letters) for _ in range(length)), letters[0] * length, (letters * length)[:length]]
    (s,) = text_slices(pa.array(texts))
    ids, bounds = codec.pieces.ids_of(s)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == LIBRARY.encode_ordinary(text)


def test_append_and_edit_equal_encoding_anew():
    vocabulary, rng = bpe.Vocabulary(RANKS), random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice("abcdehit é") for _ in range(60)).encode()
        grown = bpe.PrefixEncoder(vocabulary, text[:20])
        grown.append(text[20:])
        assert grown.last == bpe.PrefixEncoder(vocabulary, text).last
        first = rng.randint(0, len(text))
        last, new = rng.randint(first, len(text)), rng.choice([b"", b"xyz", b"the"])
        grown.edit(first, last, new)
        whole = bpe.PrefixEncoder(vocabulary, text[:first] + new + text[last:])
        assert grown.last == whole.last and grown.ids() == whole.ids()


def test_rows(spark):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, len(r.ids)) for r in bpe.encoded(docs(spark), PATH).collect())
    want = []
    for doc_id, text, *_ in DOCS:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), len(ids)))
    assert got == sorted(want)
    assert bpe.encoded(docs(spark, []), PATH).count() == 0


def test_words_that_a_polynomial_hash_confuses(codec, spark):
    texts = [w + end for length in (1024, 2048) for w in twins(length) for end in ("", " x")]
    (s,) = text_slices(pa.array(texts))
    ids, bounds = codec.pieces.ids_of(s)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == LIBRARY.encode_ordinary(text)
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    got = {r.doc_id: r.decoded_sha256 for r in bpe.encoded(docs(spark, rows), PATH).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts)}


def test_cache_is_emptied_and_pieces_are_encoded_again(codec):
    from tarnwell.llm.pretoken import PieceCache

    rng, small = random.Random(9), PieceCache(codec._encode, most=50)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdeéß1") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        (s,) = text_slices(pa.array(texts))
        ids, bounds = small.ids_of(s)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert small.slots.count < 1000  # at most a slice beyond the limit


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 5)), st.integers(0, 1000), max_size=200), st.lists(st.tuples(st.integers(0, 45), st.integers(0, 5)), max_size=50))
def test_slots_find_what_was_put_in(known, asked):
    from tarnwell.llm.common import Slots

    slots, rows = Slots(2, 4), list(known.items())
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        slots.insert(np.array([v for _, v in part], np.int32), *(np.array([k[c] for k, _ in part], np.uint64) for c in (0, 1)))
    found = slots.find(*(np.array([k[c] for k in asked], np.uint64) for c in (0, 1)))
    assert found.tolist() == [known.get(k, -1) for k in asked]
