"""Byte-level BPE by Spark higher-order functions.

Every distinct pre-token of the corpus is encoded once: its bytes become an array of
single-byte ids, and a fold merges, step by step, the leftmost pair of lowest rank, looked
up in a literal map from id pairs to ranks (a merged piece's id is its rank). As Spark looks
a map type up by scanning it, the literal is two arrays: where the row of a left id starts,
and the rows, which share one array (see rank_rows). The fold's state is one array of numbers, each an id with its place in the
word and the rank of its pair with the next, so a step looks up only the two pairs that it
makes. The ids go back to the documents by blocks (see blocks.py), and decoding concatenates
the binary pieces of the ids.

The fold takes time in the square of a word's length: a step copies the array. Words over
`fold_limit` bytes (none in ordinary prose; README.md has figures) are merged by the same
rule with a heap, where they occur, so that a very long text without white space takes time
n log n. Nulls and empty texts have no ids; pairs of equal rank are merged from the left;
repeated rows each give a row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import each_text, in_blocks, meet, name_words
from .common import id_and_text, let
from .pretokens import splitter

#: Ids and places in a word take 20 bits each, ranks what is above; NONE is above all ranks.
BITS = 20
MASK = (1 << BITS) - 1
NONE = 1 << BITS
#: Documents that are encoded at once.
ROWS = 256


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 piece and its rank on each line."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(None, content.splitlines()))}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id << 20 | right id) -> rank, for every cut of a piece into two pieces."""
    out = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                out[left << BITS | right] = rank
    return out


@lru_cache(maxsize=2)
def _rank_rows(pairs: tuple[tuple[int, int], ...], n: int) -> tuple[list[int], list[int]]:
    rows = {}
    for pair, rank in pairs:
        rows.setdefault(pair >> BITS, []).append((pair & MASK, pair >> BITS << BITS | rank))
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    starts, table, k = [0] * n, [-1] * (size + n), 0
    for left, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        while True:
            k += 1
            start = k * 2654435761 % size
            if all(table[start + right] < 0 for right, _ in row):
                break
        starts[left] = start
        for right, entry in row:
            table[start + right] = entry
    return starts, table


def rank_rows(pairs: dict[int, int], n: int) -> tuple[list[int], list[int]]:
    """(starts, table): the rank of a pair (left, right) of ids below n is in table[starts[left] + right], as left << BITS | rank.

    The rows of all left ids lie in one array, shifted so that no two entries meet; what is there of another row has another left id, what is empty is -1.
    """
    return _rank_rows(tuple(sorted(pairs.items())), n)


def encode_column(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids (array<int>) of a binary pre-token."""
    rows, table = (F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<bigint>") for x in rank_rows(pair_ranks(ranks), max(ranks.values()) + 1))  # folded when the query is planned
    single = F.array(*[F.lit(ranks[bytes([b])]).cast("long") for b in range(256)])
    # In Latin-1 every byte is a character, whose code is the byte.
    ids_of = lambda text: F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.get(single, F.ascii(F.substring(text, i, F.lit(1)))))
    first = let(F.decode(word, "ISO-8859-1"), ids_of)

    def rank(t, a, b):
        """The rank of the pair of ids a, b (long) in the tables t, or NONE, also if b is null."""
        starts, table = t
        found = F.get(table, (F.get(starts, a.cast("int")) + b).cast("int"))
        return F.when(F.shiftright(found, BITS) == a, found.bitwiseAND(F.lit(MASK).cast("long"))).otherwise(F.lit(NONE).cast("long"))

    id_of = lambda e: e.bitwiseAND(F.lit(MASK).cast("long"))
    place_of = lambda e: e.bitwiseAND(F.lit(MASK << BITS).cast("long"))
    entry = lambda r, place, i: F.shiftleft(r, 2 * BITS).bitwiseOR(place).bitwiseOR(i)
    state = lambda a: F.struct(F.array_min(a).alias("least"), a.alias("a"))
    none = F.lit(NONE << 2 * BITS).cast("long")

    def merge(t, s):
        """Merges the pair of the least entry: the lowest rank, then the leftmost."""
        a, least = s["a"], s["least"]

        def at(k):
            merged = F.shiftright(least, 2 * BITS)
            left, right = F.get(a, k - 2), F.get(a, k + 1)
            here = F.array(entry(rank(t, merged, id_of(right)), place_of(least), merged))
            before = F.when(k == 1, here).otherwise(F.concat(F.slice(a, F.lit(1), F.greatest(k - 2, F.lit(0))), F.array(entry(rank(t, id_of(left), merged), place_of(left), id_of(left))), here))
            return F.concat(before, F.slice(a, k + 2, F.size(a)))

        return let(let(F.array_position(a, least).cast("int"), at), state)

    def fold(t, ids):
        begin = state(F.transform(ids, lambda x, i: entry(rank(t, x, F.get(ids, i + 1)), F.shiftleft(i.cast("long"), BITS), x)))
        step = lambda s, _: F.when(s["least"] >= none, s).otherwise(merge(t, s))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), begin, step, lambda s: F.transform(s["a"], lambda e: id_of(e).cast("int")))

    return F.when(F.octet_length(word) > 0, let(rows, lambda r: let(table, lambda t: let(first, lambda ids: fold((r, t), ids))))).otherwise(F.array().cast("array<int>"))


def decode_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    pieces = F.from_json(F.lit(json.dumps([p.hex() for p, _ in sorted(ranks.items(), key=lambda x: x[1])])), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold's rule with a heap of pairs: time n log n."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        if not end[i] or end[i] >= j or end[i] >= n or end[end[i]] != j:
            continue
        end[end[i]], end[i] = 0, j
        if j < n:
            before[j] = i
            if (r := ranks.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : j])) is not None:
            heapq.heappush(heap, (r, before[i], j))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


@lru_cache(maxsize=2)
def _decoder(content: bytes) -> tuple[dict[bytes, int], list[bytes]]:
    ranks = parse_ranks(content)
    pieces = [b""] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        pieces[r] = p
    return ranks, pieces


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", fold_limit: int = 1024) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every text."""
    with open(ranks_path, "rb") as f:
        content = f.read()
    ranks = parse_ranks(content)
    shared = docs.sparkSession.sparkContext.broadcast(content)  # the vocabulary file
    blocked = in_blocks(id_and_text(docs, id_col, text_col))

    def words(_, texts):
        split, found = splitter(pattern), set()
        for t in texts:
            found.update(split(t))
        return [b for w in found if len(b := w.encode("utf-8")) <= fold_limit]

    named = name_words(blocked, words).groupBy("word").agg(F.collect_list("block").alias("blocks"))
    # Ids cross the shuffle in 16 bits where the vocabulary allows it.
    short = max(ranks.values()) < 1 << 16
    ids_of = encode_column(F.col("word"), ranks)
    known = named.select("blocks", F.transform(ids_of, lambda i: (i - 32768).cast("short")).alias("ids") if short else ids_of.alias("ids"))

    def documents(table: pa.Table, encoded: pa.Table) -> pa.Table:
        split, (every, pieces) = splitter(pattern), _decoder(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
        of = {}
        for chunk in encoded.column("ids").chunks:
            flat = (chunk.flatten().to_numpy().astype(np.int64) + 32768 * short).astype("<u4")
            raw, own, start = flat.tobytes(), list(map(pieces.__getitem__, flat.tolist())), 0
            for end in np.cumsum(chunk.value_lengths().to_numpy()).tolist():
                of[b"".join(own[start:end]).decode("utf-8")] = raw[4 * start : 4 * end]  # the ids alone say which word they are of
                start = end

        def long_words(parts: list[str]) -> None:
            for w in parts:
                if w not in of:
                    if len(b := w.encode("utf-8")) <= fold_limit:
                        raise KeyError(f"a word of block {table.column('block')[0]} came back without ids")
                    of[w] = np.asarray(merge_long(b, every), "<u4").tobytes()

        def encoded_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, decoded = [], []
            for t in each_text(batch):
                parts = split(t)
                try:
                    own = b"".join(map(of.__getitem__, parts))
                except KeyError:
                    long_words(parts)
                    own = b"".join(map(of.__getitem__, parts))
                ids.append(own)
                decoded.append(b"".join(map(pieces.__getitem__, np.frombuffer(own, "<u4").tolist())))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], schema=schema)

        # A batch of rows at a time: the texts, ids and bytes of a whole block would be in memory several times over, here and in the JVM.
        return pa.Table.from_batches([encoded_rows(b) for b in table.to_batches(max_chunksize=ROWS)], schema)

    return meet(blocked, known, documents, "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
