"""Token-ID / binary output (operator 9): bit-plane shuffled token files.

A file is a byte string:

    "TKPLANE1"                                      magic
    chunk 0, chunk 1, ...                           zstd frames, one for each plane
    documents                                       three coded columns: id, id is not null, ids
    chunk index                                     a record for each chunk
    footer                                          7 little-endian u64

A chunk holds CHUNK ids (the last may hold fewer) as 32-bit integers, transposed
into four byte planes: first all lowest bytes, last all highest.  Each plane is
compressed by itself, so the planes that are nearly constant cost nearly nothing.
An index record has the chunk's place, its number of ids and the sizes of its
planes, so any chunk is read without those before it.

Files are rows of a table that Spark writes (file, part, ids before this part in
the file, content): Spark's writers reach any store and commit whole tasks, so a
lost executor leaves neither a part of a file nor two of one.  `export` puts them
into a folder as plain files.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder
from .common import map_arrow, text_slices
from .pretoken import PieceCache

MAGIC = b"TKPLANE1"
CHUNK = 1 << 16
FILE_IDS = 1 << 22
LEVEL = 3
JOINED = 4096  # pieces that go to the library together
_INDEX = struct.Struct("<QI4I")
_FOOTER = struct.Struct("<7Q")


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of fixed-width integers, all lowest bytes first."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)


def _unplaned(planes: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of documents with these ids, one after the other."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    out, index, at = [MAGIC], [], len(MAGIC)
    ids = np.ascontiguousarray(ids, "<u4")
    for first in range(0, len(ids), CHUNK):
        chunk = ids[first : first + CHUNK]
        planes = [press.compress(p.tobytes()) for p in _planes(chunk)]
        index.append(_INDEX.pack(at, len(chunk), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    columns = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], "u1"), np.asarray(lengths, "<i8")]
    packed = [press.compress(_planes(c).tobytes()) for c in columns]
    index_at = at + sum(map(len, packed))
    footer = _FOOTER.pack(len(ids), len(doc_ids), at, *map(len, packed), index_at)
    return b"".join([*out, *packed, *index, footer])


def read_chunk(content: bytes, k: int) -> np.ndarray:
    """The ids of chunk ``k`` alone, by the chunk index."""
    index_at = _FOOTER.unpack_from(content, len(content) - _FOOTER.size)[-1]
    at, n, *sizes = _INDEX.unpack_from(content, index_at + k * _INDEX.size)
    planes, expand = [], zstandard.ZstdDecompressor()
    for size in sizes:
        planes.append(expand.decompress(content[at : at + size], max_output_size=n))
        at += size
    return _unplaned(b"".join(planes), "<u4")


def unpack(content: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """All ids, the documents' ids, and how many ids each has."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    n_ids, n_docs, at, *sizes, _ = _FOOTER.unpack_from(content, len(content) - _FOOTER.size)
    columns, expand = [], zstandard.ZstdDecompressor()
    for size, dtype in zip(sizes, ("<i8", "u1", "<i8"), strict=True):
        columns.append(_unplaned(expand.decompress(content[at : at + size], max_output_size=max(1, n_docs * 8)), dtype) if n_docs else np.zeros(0, dtype))
        at += size
    chunks = [read_chunk(content, k) for k in range(-(-n_ids // CHUNK))]
    ids = np.concatenate(chunks) if chunks else np.zeros(0, "<u4")
    return ids, [d if known else None for d, known in zip(columns[0].tolist(), columns[1].tolist(), strict=True)], columns[2]


@lru_cache(maxsize=1)
def _spelling() -> np.ndarray:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it
    is visible, else one of the signs from 256 on, in order."""
    visible = np.zeros(256, bool)
    for low, high in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)):
        visible[low : high + 1] = True
    return np.where(visible, np.arange(256), 255 + np.cumsum(~visible)).astype("<u2")


class _Encoder:
    """Encodes slices as the tokenizers library would, without tokens of its own.

    Pieces that were met before are looked up.  A document that holds the string
    of an added token goes to the library whole, as such strings are cut out of
    a text before its pieces are."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.added = [token.content.encode() for token in self.library.get_added_tokens_decoder().values()]
        # the same without the cutting, for pieces that are cut and spelled already
        self.words = Tokenizer.from_str(json.dumps(json.loads(definition) | {"pre_tokenizer": None, "post_processor": None}))
        self.width = np.array([len(self.library.id_to_token(k) or "") for k in range(self.library.get_vocab_size())])
        self.pieces = PieceCache(self._encode)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces.  They go to the library many at a time; as each sign
        of a token stands for a byte, sums of widths tell whose an id is."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size)
        spelled = _spelling()[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-16-le")
        words = [spelled[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
        rows = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        found = self.words.encode_batch_fast(rows, is_pretokenized=True, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32)
        upto = np.searchsorted(np.cumsum(self.width[ids]), end) + 1
        return ids, np.diff(upto, prepend=0)

    def ids_of(self, s) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each document's."""
        ids, bounds = self.pieces.ids_of(s)
        raw = s.data.tobytes()
        if not any(token in raw for token in self.added):
            return ids, bounds
        own = np.split(ids, bounds[1:-1])
        for k, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
            if any(token in raw[a:b] for token in self.added):
                own[k] = np.array(self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids, ids.dtype)
        return np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))


_encoders: dict[str, _Encoder] = {}


def _encoder(name: str, definition) -> _Encoder:
    """This worker's encoder of a broadcast definition."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = _Encoder(definition.value)
    return _encoders[name]


def write_files(docs: DataFrame, path: str, target: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode the documents in ascending id order, ``end_id`` after each, and
    write them as token files to the folder ``target``; the table of files.

    ``path`` is a tokenizers definition with byte-level pieces; strings of its
    added tokens in a text become those tokens, as in the library.  Null texts are
    empty (only the end id); null doc ids come first; repeated rows are written
    as often as they come, rows of one id in the order of a hash of their text and
    then of the text, so that every run gives the same files; no rows make no file.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        text = f.read()
    name, definition = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)

    def encode(batches):
        encoder, part, before = _encoder(name, definition), 0, 0
        number = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        waiting = 0

        def file():
            nonlocal part, before, waiting
            row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part]), pa.array([before]), pa.array([waiting]), pa.array([pack(np.concatenate(ids), names, np.concatenate(lengths))], pa.binary())], ["file", "part", "ids_before", "n_ids", "content"])
            part, before, waiting = part + 1, before + waiting, 0
            ids.clear(), names.clear(), lengths.clear()
            return row

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for s in text_slices(batch.column("text")):
                own, bounds = encoder.ids_of(s)
                own = np.insert(own, bounds[1:], end_id)
                ids.append(own)
                names += doc_ids[s.first : s.last]
                lengths.append(np.diff(bounds) + 1)
                waiting += len(own)
                if waiting >= file_ids:
                    yield file()
        if waiting:
            yield file()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the hash also deals the rows of an id that very many rows share
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    schema = "file long, part long, ids_before long, n_ids long, content binary"
    map_arrow(rows, encode, schema).write.option("maxRecordsPerFile", 0).parquet(target)
    return spark.read.schema(schema).parquet(target)


def read_files(files: DataFrame) -> DataFrame:
    """What the files hold, by document: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32."""
    spark = files.sparkSession
    totals = sorted(tuple(r) for r in files.groupBy("file").agg(F.sum("n_ids")).collect())  # one for each task that wrote
    before, starts = 0, []
    for file, count in totals:
        starts.append((file, before))
        before += count
    starts = F.broadcast(spark.createDataFrame(starts, "file long, file_start long"))

    def decode(batches):
        for batch in batches:
            for content, first in zip(batch.column("content"), batch.column("first").to_pylist(), strict=True):
                ids, names, lengths = unpack(content.as_py())
                end = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(end.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(end - lengths + first), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(starts, "file").select("content", (F.col("file_start") + F.col("ids_before")).alias("first"))
    return map_arrow(placed, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(files: DataFrame, folder: str) -> DataFrame:
    """Put each file into a folder that every executor has mounted; returns
    their paths.  A file gets its name only when it is whole."""

    def put(batches):
        for batch in batches:
            paths = []
            for file, part, content in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "content")), strict=True):
                paths.append(f"{folder}/tokens-{file:08d}-{part:06d}.tkp")
                with open(f"{paths[-1]}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                    f.write(content)
                os.replace(f.name, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return map_arrow(files.select("file", "part", "content"), put, "path string")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{shared_folder(spark, 'token-files')}/files"))
