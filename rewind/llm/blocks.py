"""Word tables of bounded blocks of documents.

What is known about a distinct word (its token ids, its count, its likelihood) has to meet
every document that holds the word. Neither shuffling word occurrences nor broadcasting the
vocabulary would scale, so documents are dealt by a hash of their id into blocks of about
`block_bytes` of text, which travels packed. Each block names its distinct words once; a word is worked out once
for the whole corpus; the results go back to the blocks that named it. A block's table is
bounded by the block's text, a word's rows by the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BLOCK_BYTES = 24 << 20


def in_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, packed, block): each text compressed, with the number of its block."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def pack(batches):
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compress(t.encode("utf-8")) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])

    packed = arrow_map(texts.select("doc_id", "text"), pack, "doc_id long, packed binary")
    return packed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))


def each_text(table: pa.Table | pa.RecordBatch) -> Iterator[str]:
    """The texts of a block, one at a time."""
    decompress = zstandard.ZstdDecompressor().decompress
    for b in table.column("packed"):
        yield decompress(b.as_buffer()).decode("utf-8")


def unpacked(table: pa.Table) -> list[str]:
    """The texts of a block."""
    return list(each_text(table))


def name_words(blocked: DataFrame, words: Callable[[list, Iterator[str]], list[bytes]]) -> DataFrame:
    """(block, word): the distinct words of each block by words(ids, texts)."""

    def of_block(table: pa.Table) -> pa.Table:
        found = words(table.column("doc_id").to_pylist(), each_text(table))
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(found), pa.int32()), pa.array(found, pa.binary())], ["block", "word"])

    return blocked.groupBy("block").applyInArrow(of_block, "block int, word binary")


def by_word(named: DataFrame) -> DataFrame:
    """(word, n, blocks) of (block, word, n): one row a distinct word, with its count in all blocks and the blocks that named it."""
    return named.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))


def meet(blocked: DataFrame, known: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn(documents of a block, known rows of its words); known has the blocks of by_word."""
    back = known.withColumn("block", F.explode("blocks")).drop("blocks")
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(fn, schema)
