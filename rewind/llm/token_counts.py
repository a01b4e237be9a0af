"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact table of the lengths (in tokens) of the most frequent pre-tokens.
Each task summarises the pre-tokens of its own texts in a bounded table of heavy hitters;
only those summaries, of at most `per_task` rows a task, are merged. The table has at most
`table_size` entries whatever the corpus, so it is broadcast. Tier 2 encodes whatever the
table lacks with the library and remembers it in a bounded cache of the Python worker.
No pre-token occurrence is ever shuffled, and the tiers only decide where a length comes
from, never what it is.

Nulls and empty texts count no tokens; a text is counted whole however long; pre-tokens that
are equally frequent enter the table in their own order; repeated rows and repeated ids each give a row;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, text_blocks
from .pretokens import splitter

#: The pattern of the byte-level pre-tokenizer of tokenizers files (a fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Lengths(dict):
    """Token counts of pre-tokens: the frequent table, and a bounded cache of the rest."""

    def __init__(self, definition: str, table: dict[str, int] | None = None, bound: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__(table or {})
        self.table, self.bound = table or {}, bound
        self.library = Tokenizer.from_str(definition)
        self.special = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.split = splitter(BYTE_LEVEL)

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(self) >= self.bound:
            self.clear()
            self.update(self.table)
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        for s in self.special:
            if s in text:  # the library cuts the text at its special strings
                return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.split(text)))


def check_definition(definition: str) -> None:
    """The two tiers hold for byte-level BPE that splits by the standard pattern and nothing else."""
    d = json.loads(definition)
    p = d["pre_tokenizer"]
    if d["normalizer"] or d["model"]["type"] != "BPE" or p["type"] != "ByteLevel" or p["add_prefix_space"] or not p["use_regex"]:
        raise ValueError("token_counts needs a plain byte-level BPE tokenizer")


_workers: dict[bytes, Lengths] = {}


def frequent_pretokens(texts: DataFrame, table_size: int = 32_768, per_task: int = 8_192, task_bound: int = 500_000) -> list[str]:
    """The most frequent pre-tokens of an id_and_text table, from bounded summaries of all its texts."""

    def summarise(batches):
        split, counts = splitter(BYTE_LEVEL), Counter()
        for _, block in text_blocks(batches):
            for text in block:
                counts.update(split(text))
            if len(counts) > task_bound:
                counts = Counter(dict(counts.most_common(task_bound // 2)))
        top = counts.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    merged = arrow_map(texts, summarise, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in merged.orderBy(F.desc("n"), "piece").limit(table_size).select("piece").collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, table_size: int = 32_768, cache_bound: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    check_definition(definition)
    texts = id_and_text(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    plain = Lengths(definition)
    table = {p: plain[p] for p in frequent_pretokens(texts, table_size)}
    shared = context.broadcast((definition, table))  # bounded by the vocabulary file and table_size
    key = hashlib.sha256(json.dumps([definition, table, cache_bound]).encode("utf-8")).digest()  # workers outlive queries

    def count(batches):
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(*shared.value, bound=cache_bound)
        lengths = _workers[key]
        for ids, block in text_blocks(batches):
            n = [lengths.count(t) for t in block]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8")) for t in block], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(texts, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
