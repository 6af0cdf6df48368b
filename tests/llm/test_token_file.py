import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwell.llm import token_file
from tarnwell.llm.common import text_slices

from .cases import DOCS, docs, twins

PATH = P.path("byte_bpe_50k.json")
ENCODER = token_file._Encoder(open(PATH, encoding="utf-8").read())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**62), 2**62)), st.integers(0, 30)), max_size=20))
def test_round_trip(documents):
    lengths = np.array([n for _, n in documents], np.int64)
    ids = np.random.default_rng(1).integers(0, 2**32, int(lengths.sum()), dtype=np.uint32)
    out = token_file.unpack(token_file.pack(ids, [d for d, _ in documents], lengths))
    assert out[0].tolist() == ids.tolist() and out[1] == [d for d, _ in documents] and out[2].tolist() == lengths.tolist()


def test_chunks_are_read_alone_and_planes_shrink():
    ids = np.random.default_rng(2).integers(0, 50_000, 2 * token_file.CHUNK + 5, dtype=np.uint32)
    content = token_file.pack(ids, [1], np.array([len(ids)]))
    for k in range(3):
        assert token_file.read_chunk(content, k).tolist() == ids[k * token_file.CHUNK : (k + 1) * token_file.CHUNK].tolist()
    assert len(content) < 2.1 * len(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["'s", " ", "\n", "\r\n", "a", "é", "1", "!", "\u00a0", "\x1c", "漢", " the"]), max_size=12).map("".join)), max_size=4))
def test_pieces_equal_library(texts):
    for s in text_slices(pa.array(texts, pa.string())):
        ids, bounds = ENCODER.ids_of(s)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ENCODER.library.encode(t, add_special_tokens=False).ids for t in texts[s.first : s.last]]


def test_words_that_a_polynomial_hash_confuses():
    texts = [w for length in (1024, 2048) for w in twins(length)]
    (s,) = text_slices(pa.array(texts))
    ids, bounds = ENCODER.ids_of(s)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ENCODER.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_of_one_id_have_an_order(spark, tmp_path):
    rows = [(k % 3, f"text {k % 7}", None, None, 0) for k in range(60)]
    found = []
    for name, parts in (("one", 1), ("many", 9)):
        files = token_file.write_files(docs(spark, rows).repartition(parts), PATH, str(tmp_path / name))
        found.append(sorted(map(tuple, token_file.read_files(files).collect())))
    assert found[0] == found[1] and len(set(found[0])) == 60


def test_files_equal_library(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    files = token_file.write_files(docs(spark), PATH, str(tmp_path / "files"), file_ids=1000)
    assert files.count() > 1
    got = {}
    for r in token_file.read_files(files).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    at = 0
    for doc_id, text, *_ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (at, len(ids), zlib.crc32(ids.tobytes())) in got[doc_id]
        at += len(ids)
    assert sum(map(len, got.values())) == len(DOCS)


def test_added_tokens_in_texts_equal_library(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|>", "plain  text", "a  <|endoftext|>  b<|endoftext|><|endoftext|>\n\n c", "", "<|endoftext|", "it's <|endoftext|>'s end", "plain <|ENDOFTEXT|>"]
    files = token_file.write_files(docs(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)]).coalesce(1), PATH, str(tmp_path / "files"))
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_file.read_files(files).collect()}
    for k, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes()))


def test_export_and_empty(spark, tmp_path):
    files = token_file.write_files(docs(spark), PATH, str(tmp_path / "files"))
    (tmp_path / "out").mkdir()
    paths = [r.path for r in token_file.export(files, str(tmp_path / "out")).collect()]
    assert sorted(map(str, (tmp_path / "out").iterdir())) == sorted(paths)
    assert sum(len(token_file.unpack(open(p, "rb").read())[1]) for p in paths) == len(DOCS)
    none = token_file.write_files(docs(spark, []), PATH, str(tmp_path / "none"))
    assert none.count() == 0 and token_file.read_files(none).count() == 0
