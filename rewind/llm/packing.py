"""Packing along a space-filling curve.

A document's hashed vector (byte trigrams into `HASHED` cells, damped and normalised) is
projected to three dimensions by a fixed random matrix; the Hilbert key of that point orders
the documents, so that neighbours on the curve have similar texts. Documents are
range-partitioned and sorted by (key, id), tokenised where they lie, and laid end to end:
prefix sums of the partitions' token totals (a table as long as the number of partitions)
place each document, and sequences are cut at every `length` tokens. Only the last sequence
is not full.

Nulls and empty texts hold the end token only; equal keys are ordered by id; repeated ids
each give their pieces; a text of any length is cut only where sequences end; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, durable, id_and_text, shuffle_partitions
from .pretokens import is_safe, splitter

HASHED, DIMS, BITS = 512, 3, 10


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indexes of integer points (n, dims) with coordinates below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS))


def curve_keys(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text's projected vector."""
    if not texts:
        return np.empty(0, np.int64)
    counts = np.empty((len(texts), HASHED))
    for k, t in enumerate(texts):
        a = np.frombuffer(t.encode("utf-8"), np.uint8).astype(np.uint32)
        cells = (a[:-2] * 31 + a[1:-1] * 1009 + a[2:] * 9176) % HASHED if len(a) > 2 else a
        counts[k] = np.bincount(cells, minlength=HASHED)
    x = np.sqrt(counts)
    x -= x.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    y = (x / np.where(norm > 0, norm, 1)) @ matrix
    squashed = 1 / (1 + np.exp(-1.7 * y))  # about the normal distribution function
    return hilbert_keys(np.minimum((squashed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}


#: Ends a word's bytes: no UTF-8 holds it.
WORD_END = b"\xff"


class WordIds(dict):
    """Ids of pre-tokens as little-endian unsigned 16-bit bytes, remembered up to a bound.

    A word that isn't remembered is merged by ranks, several times faster than through the
    tokenizer's own library: the mark of a word's end becomes a byte that first joins the last
    letter, and a merge's place in the file is the rank of the piece it makes. Ranks of pieces
    and merges of pairs agree as each piece comes of one pair (tests/llm compares them).
    """

    def __init__(self, definition: str, bound: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        d = json.loads(definition)
        pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [n["type"] for n in d["normalizer"]["normalizers"]]
        vocabulary, model = d["model"]["vocab"], d["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or max(vocabulary.values()) > 0xFFFF or model["end_of_word_suffix"] != "</w>" or model["type"] != "BPE":
            raise ValueError("packing needs a lower-casing word BPE tokenizer with ids below 65536")
        self.library, self.bound = Tokenizer.from_str(definition), bound
        self.special = [t["content"] for t in d["added_tokens"]]
        self.split = splitter(pattern, removed=True)
        letters = byte_letters()
        raw = lambda t: bytes([letters[c] for c in t.removesuffix("</w>")]) + WORD_END * t.endswith("</w>")
        name = {b: c for c, b in letters.items()}
        pieces = [name[b] for b in range(256)] + [name[b] + "</w>" for b in range(255)] + ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks = {raw(p): k for k, p in enumerate(pieces)}
        if len(ranks) < len(pieces):
            raise ValueError("a piece is made by two merges")
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.id_of = np.array([vocabulary[p] for p in pieces], "<u2")

    def __missing__(self, word: str) -> bytes:
        ids = self.id_of[self.merge(word.encode("utf-8") + WORD_END)].tobytes()
        if len(self) >= self.bound:
            self.clear()
        self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.plain(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if not is_safe(text):
                return self.plain(text)
            text = text.replace("Σ", "σ")  # the library lower-cases without context
        text = text.lower()
        if not is_safe(text):
            return self.plain(text)
        return b"".join(map(self.__getitem__, self.split(text)))


_workers: dict[bytes, WordIds] = {}


def ordered_ids(docs: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, curve_key, n, ids (16-bit), part: tokenised along the curve, stored in that order."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # the vocabulary file
    key, matrix, tail = hashlib.sha256(definition.encode("utf-8")).digest(), projection(), np.asarray([end_id], "<u2").tobytes()

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(curve_keys(batch.column(1).to_pylist(), matrix), pa.int64())], ["doc_id", "text", "curve_key"])

    def tokenised(batches):
        if key not in _workers:
            _workers.clear()
            _workers[key] = WordIds(shared.value)
        words = _workers[key]
        for batch in batches:
            ids = [words.ids(t) + tail for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(b) // 2 for b in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "curve_key", "n", "ids"])

    texts = arrow_map(id_and_text(docs, id_col, text_col), keyed, "doc_id long, text string, curve_key long")
    ranged = texts.repartitionByRange(shuffle_partitions(docs.sparkSession), "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")
    return durable(arrow_map(ranged, tokenised, "doc_id long, curve_key long, n long, ids binary").withColumn("part", F.spark_partition_id()))


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, curve_key."""
    stored = ordered_ids(docs, tokenizer_path, end_id, id_col=id_col, text_col=text_col)
    totals = stored.groupBy("part").agg(F.sum("n").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))

    def pieces(batches):
        # In stored order; a task can hold several partitions one after another.
        part, at = None, 0
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], [], [], []]
            for doc, curve, n, ids, own, before in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "curve_key", "n", "ids", "part", "before")), strict=True):
                if own != part:
                    part, at = own, before
                values = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < n:
                    k = min(n - start, length - at % length)
                    for c, v in zip(columns, (doc, start, k, values[start : start + k].tobytes(), n, at // length, at % length, curve), strict=True):
                        c.append(v)
                    start, at = start + k, at + k
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve_key"])

    laid = stored.join(F.broadcast(offsets), "part").select("doc_id", "curve_key", "n", "ids", "part", "before")  # as many rows as partitions
    return arrow_map(laid, pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve_key long")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "curve_key")
