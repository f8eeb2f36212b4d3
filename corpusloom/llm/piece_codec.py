"""Encoding and decoding with a piece vocabulary (byte-pair pieces with byte fallback).

White space is written as U+2581 and a text that isn't empty gets one in front. No piece holds that mark inside
other characters, nor a line feed, so a text falls into independent words; each distinct word is merged once by
the vectorised rounds of :mod:`bpe` and its ids are remembered. Characters outside the vocabulary become their
UTF-8 bytes' pieces. Decoding is a gather over the concatenated pieces' bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Merges
from .common import frugal, frugal, spread, table, text_column

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile("\n|▁*[^▁\n]+|▁+")


class PieceCodec:
    def __init__(self, path: str, most: int = 600_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.bos, self.eos, self.most = model.bos_id(), model.eos_id(), most
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
        pieces = [model.id_to_piece(i) for i in range(size)]
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        if any("\n" in p for p in ids) or any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece crosses words; this vocabulary needs another way of splitting")
        order = np.unique([-model.get_score(i) for i in range(size)], return_inverse=True)[1]
        rows = [(ids[p[:k]], ids[p[k:]], order[i], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.merges = Merges(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        # symbols of characters outside the vocabulary are -2 - code point until the end
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "<u4")
        raw = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.piece_size = np.array([len(x) for x in raw])
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            points = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").astype(np.int64)
            own = self.of_char[points]
            counts = np.array([len(w) for w in part])
            flat, sizes = self.merges.merge(np.where(own >= 0, own, -2 - points), counts)
            unknown = np.flatnonzero(flat < 0)
            if len(unknown):  # byte fallback
                raw = [np.frombuffer(chr(-2 - x).encode(), np.uint8) for x in flat[unknown].tolist()]
                wide = np.ones(len(flat), np.int64)
                wide[unknown] = [len(x) for x in raw]
                word = np.repeat(np.arange(len(part)), sizes)
                out = np.repeat(flat, wide)
                out[np.repeat(flat < 0, wide)] = self.byte_ids[np.concatenate(raw)]
                sizes = np.bincount(word, weights=wide, minlength=len(part)).astype(np.int64)
                flat = out
            raw_ids = flat.astype("<u4").tobytes()
            ends = (4 * np.cumsum(sizes)).tolist()
            begin = 0
            for w, end in zip(part, ends, strict=True):
                into[w] = raw_ids[begin:end]
                begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, begin and end ids included."""
        split = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = set().union(*split)
        known = self.known
        new = list(wanted.difference(known))
        if len(known) + len(new) > self.most:  # a dictionary of these texts' own; it is the next memory if it may
            known = {w: known[w] for w in wanted if w in known}
            self.known = known if len(wanted) <= self.most else {}
        if new:
            self.learn(new, known)
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.bos, self.eos))
        return [begin + b"".join([known[w] for w in part]) + end for part in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text; bytes that aren't valid UTF-8 become U+FFFD."""
        sizes = self.piece_size[ids]
        raw = self.piece_bytes[spread(self.piece_start[ids], sizes)].tobytes() if len(ids) else b""
        solid = ids[sizes > 0]
        if len(solid) and self.piece_bytes[self.piece_start[solid[0]]] == 32:
            raw = raw[1:]  # the mark put in front
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@frugal
def run(path: str):
    def encode_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offsets = text_column(batch)
            whole = memoryview(data)
            n_tokens, ids_sha, text_sha = [], [], []
            for at in range(0, len(batch), 256):
                stop = min(at + 256, len(batch))
                for raw in own.encode([str(whole[offsets[i] : offsets[i + 1]], "utf-8") for i in range(at, stop)]):
                    n_tokens.append(len(raw) // 4)
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(np.frombuffer(raw, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encode_decode


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the decoded text; no shuffle.

    Null and empty texts give the begin and end ids; texts of any length and repeated rows are encoded whole;
    other columns aren't read.
    """
    return docs.select("doc_id", "text").mapInArrow(run(model_path), SCHEMA)


def op9_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op9_piece_round_trip": op9_piece_round_trip}
