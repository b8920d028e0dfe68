"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from a public vocabulary.

``sentencepiece_model`` writes the model's protocol buffer directly: one piece per rank, its bytes mapped to
printable characters, scored by the negative rank, with identity normalisation. Best score first, leftmost first
is then the same merge order as lowest rank first. Texts are cut by the vocabulary's own pattern and each pre-token
is encoded by itself; a pre-token that is a piece is its id. Decoding takes the pieces of the model and maps their
characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasweave.llm._spark import bounded
from atlasweave.llm._text import pieces

CACHE = 200_000  # pre-tokens whose ids a worker keeps


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(p) for p, r in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """The serialised model; ids are ranks, and the unknown piece that the format asks for comes last."""
    chars = byte_characters()
    out = []
    for rank, piece in enumerate(vocabulary):
        out.append(_field(1, _field(1, "".join(chars[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class _Known(dict):
    """Pre-tokens to ids; one that is missing is encoded and kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, token: str) -> bytes:
        out = self[token] = self.codec.learn(token)
        return out


class Codec:
    """Encodes and decodes; one for each Python worker."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.find = regex.compile(pattern).findall
        self.ids = {p: i for i, p in enumerate(vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(vocabulary))
        self.map = dict(enumerate(byte_characters()))
        back = {ord(c): b for b, c in self.map.items()}
        # the bytes of each piece of the model, by the inverse mapping of its characters
        self.bytes_of = [self.model.IdToPiece(i).translate(back).encode("latin-1") for i in range(len(vocabulary))]
        self.known = _Known(self)

    def learn(self, token: str) -> bytes:
        """The ids of one pre-token."""
        raw = token.encode()
        own = self.ids.get(raw)
        if own is not None:
            return own.to_bytes(4, "little")
        ids = self.model.EncodeAsIds(raw.decode("latin-1").translate(self.map))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    key, vocabulary, pattern = shared.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary, pattern)
    return _CODECS[key]


def share(spark, vocabulary: str, pattern: str):
    """The vocabulary of a rank file, sent to the workers; its size is fixed by the file (under 1 MB for 50,000 pieces)."""
    ranks = read_ranks(vocabulary)
    return spark.sparkContext.broadcast((hashlib.sha256(b"\0".join(ranks) + pattern.encode()).hexdigest(), ranks, pattern))


def _int_lists(ids: list[bytes]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _encoded(shared):
    """(doc_id, text) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), _int_lists([codec.encode(t) if t else b"" for t in b.column(1).to_pylist()])], ["doc_id", "ids"])

    return run


def _decoded(shared):
    """(doc_id, ids) to (doc_id, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                off = np.asarray(lists.offsets)
                ids = lists.values.to_numpy()[off[0] : off[-1]].tolist()
                cut = (off - off[0]).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([codec.decode(ids[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text; null or empty text has none. Rows that repeat give rows that repeat."""
    return _texts(docs, id_col, text_col).mapInArrow(_encoded(shared), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, shared) -> DataFrame:
    """(doc_id, ids) with ``decoded``, the bytes that the ids stand for; null ids have none."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(shared), "doc_id long, ids array<int>, decoded binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, own, back = [], [], []
        flat, off = b.column(1).values.to_numpy(), np.asarray(b.column(1).offsets)
        for i, d in enumerate(b.column(2)):
            n.append(int(off[i + 1] - off[i]))
            own.append(hashlib.sha256(flat[off[i] : off[i + 1]].astype("<u4").tobytes()).hexdigest())
            back.append(hashlib.sha256(d.as_buffer()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(own), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids (little-endian unsigned 32-bit) and of the decoded bytes."""
    import public_tokenizers

    shared = share(docs.sparkSession, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    # encoded, decoded and digested in one worker, so that a task holds one model
    steps = lambda batches: _digests(_decoded(shared)(_encoded(shared)(batches)))
    return _texts(docs, "doc_id", "text").mapInArrow(steps, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
