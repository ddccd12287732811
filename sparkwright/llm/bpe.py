"""Byte-level BPE by a sentencepiece model that is serialised from a rank file.

Each byte is mapped to a visible character; every token becomes a piece of mapped characters scored by its
negative rank, so the model merges exactly as ranks do; normalisation is the identity. Pre-tokens are encoded
one by one, ids are decoded by the inverse mapping.

Defined results: a null or empty text has no ids. Rows are independent; repeated rows repeat, extra columns are
ignored, an empty table gives no rows. Whole texts are processed; memory is bounded by a slice of 4 MB of text
(or one longer row) and by caches of ``CACHE`` entries a worker.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

CACHE, LONGEST = 300_000, 48
#: public_tokenizers.PATTERN with its disjoint alternatives in another order and possessive where nothing follows: the same matches, faster.
PATTERN = r""" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
UNKNOWN, BETWEEN = "<unk>", "\u2581"


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where it is printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b if b in printable else 256 + n))
        n += b not in printable
    return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2, ...")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes((n & 127 | 128,)), n >> 7
    return out + bytes((n,))


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n & (1 << 64) - 1)


def _message(tag: int, data: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose piece ``i`` is token ``i``; the unknown piece follows the last one."""
    chars = byte_characters()
    pieces = [("".join(map(chars.__getitem__, t)), -float(k), 1) for k, t in enumerate(tokens)] + [(UNKNOWN, 0.0, 2)]
    body = b"".join(_message(1, _message(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _number(3, kind)) for p, s, kind in pieces)
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43))
    normalizer = _message(1, b"identity") + b"".join(_number(k, 0) for k in (3, 4, 5))
    return body + _message(2, trainer) + _message(3, normalizer)


class PieceEncoder:
    """Encodes pre-tokens by the sentencepiece model of a rank file; decodes ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.tokens = read_ranks(path)
        self.whole = {t: k for k, t in enumerate(self.tokens)}
        self.model = SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.table = dict(enumerate(byte_characters()))

    def encode(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pre-token; one that is itself a token is that token.

        All go to the model in one string, with a character between them that no piece holds: nothing merges across
        it, and it comes back as the unknown id, at which the ids are cut apart again.
        """
        data = [p.encode() for p in pretokens]
        out = [w.to_bytes(4, "little") if (w := self.whole.get(d)) is not None else b"" for d in data]
        rest = [k for k, x in enumerate(out) if not x]
        joined = BETWEEN.join([data[k].decode("latin-1").translate(self.table) for k in rest])
        ids = np.array(self.model.encode(joined), "<u4")
        cuts, flat = np.flatnonzero(ids == len(self.tokens)).tolist(), ids.tobytes()
        for k, i, j in zip(rest, [-1, *cuts], [*cuts, len(ids)], strict=True) if rest else ():
            out[k] = flat[4 * i + 4 : 4 * j]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder:
    """Ids (little-endian unsigned 32-bit) of whole texts, pre-token by pre-token, with a bounded cache."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]]):
        self.cut, self.encode = regex.compile(pattern).findall, encode
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        found, known = self.cut(text), self.known
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        new = [w for w in dict.fromkeys(found) if w not in known]
        own = dict(zip(new, self.encode(new), strict=True))
        known.update(own)
        done = b"".join(map(known.__getitem__, found))
        for w in [w for w in new if len(w) > LONGEST]:
            del known[w]
        return done


@lru_cache(maxsize=2)
def piece_encoder(path: str, pattern: str) -> tuple[PieceEncoder, TextEncoder]:
    """One model and one cache a worker process."""
    pieces = PieceEncoder(path)
    return pieces, TextEncoder(pattern, pieces.encode)


def encode_texts(df: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text as little-endian unsigned 32-bit integers."""
    def run(batches):
        _, encode = piece_encoder(path, pattern)
        for batch in batches:
            for b in slices(batch, "text"):
                ids = [encode(t) if t else b"" for t in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_ids(df: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, data): the bytes that ids stand for."""
    def run(batches):
        pieces, _ = piece_encoder(path, pattern)
        for batch in batches:
            for b in slices(batch, "ids"):
                data = [pieces.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return df.mapInArrow(run, "doc_id long, ids binary, data binary")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded, and decoded from its ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
