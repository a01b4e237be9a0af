"""Language-model scores by the likelihood of a subword lattice.

A word is spelled by pieces of an existing vocabulary, or by the bytes of a character, in
many ways. Its lattice probability is the sum over all of them, by a forward recursion in
log space, run over many words at once, one level of nodes after another. A word of the training texts has one more arc, across the whole word, weighted by
its discounted count; the discounts are the weight of the piece arcs. A text's probability
is the product over its words and one end symbol.

Piece weights start from the vocabulary's own scores. A vocabulary of merges scores a piece
by minus its rank, read here as a Zipf law. A few expectation steps over the training words
(forward-backward on every distinct word; one discount each is what the piece arcs get) give
expected piece counts, and the weights are those counts with the vocabulary's weights as
prior. Words meet their
documents by blocks (see blocks.py): each distinct word is scored once.

Beside it stands the base: word counts of the training texts with add-half smoothing.

Nulls and empty texts hold the end symbol only; repeated rows each give a row (and count
each); without training rows N and V are 0; an empty table gives an empty table; extra
columns are ignored; a null id is a training row. A word of any length has one lattice, in
time and memory linear in it, and a text is the sum over its words. Nothing depends on an
order among equal words or rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_word, in_blocks, meet, unpacked
from .common import arrow_map, durable, id_and_text

#: The end symbol among words: no word of a text holds white space.
END = b" "
LOG10 = math.log(10)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white space characters (both as bytes methods define them)."""
    return text.encode("utf-8").lower().split()


@lru_cache(maxsize=1)
def finder(pieces: tuple[str, ...]):
    """An automaton that gives the end and number of every occurrence of a piece."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, p in enumerate(pieces):
        automaton.add_word(p, k)
    automaton.make_automaton()
    return automaton


class Arcs:
    """The arcs of the lattices of many words, which stand side by side in one line with a gap after each.

    A node is a place in the line: a word of n characters (its mark among them) has n + 1, and
    the gap is the last. Arcs are in the order of their end's level, its distance from the
    word's first node, so that what is needed for a level is known once those before it are done.
    """

    def __init__(self, words: list[bytes], automaton, size: np.ndarray):
        line = " ".join(["▁" + w.decode("utf-8") for w in words])  # no word holds a space
        self.code = np.frombuffer(line.encode("utf-32-le"), "<u4")
        gaps = np.flatnonzero(self.code == 32)
        first, self.last = np.append(0, gaps + 1), np.append(gaps, len(self.code))
        level = np.arange(len(self.code) + 1) - np.repeat(first, self.last - first + 1)
        found = np.fromiter((e << 20 | p for e, p in automaton.iter(line)), np.int64)
        piece, letter = found & 0xFFFFF, np.flatnonzero(self.code != 32)
        end = np.append((found >> 20) + 1, letter + 1)
        order = np.argsort(end, kind="stable")
        deep = level[end[order]]
        order = order[np.argsort(deep.astype(np.uint16) if deep.max(initial=0) < 1 << 16 else deep, kind="stable")]
        self.end = end[order]
        self.start = np.append((found >> 20) + 1 - size[piece], letter)[order]
        self.piece = np.append(piece, np.full(len(letter), -1))[order]  # -1: the bytes of a character
        self.groups = np.append(0, np.flatnonzero(np.diff(self.end)) + 1)  # the arcs into one node each
        depth = level[self.end]
        levels = np.arange(1, depth.max(initial=0) + 2)
        self.at = np.searchsorted(depth, levels)
        self.group_at = np.searchsorted(depth[self.groups] if len(depth) else depth, levels)


class Lattice:
    """Piece weights and the two recursions. pieces: piece -> weight; sums to 1 with byte and end weights."""

    def __init__(self, vocabulary: tuple[list[tuple[str, float]], dict[int, float], float]):
        pieces, self.bytes, self.end = vocabulary
        self.pieces = dict(pieces)
        self.names = tuple(self.pieces)
        self.weight = np.array(list(self.pieces.values()))
        self.size = np.array([len(p) for p in self.names])
        self.automaton = finder(self.names)

    def spell(self, c: str) -> float:
        return sum(self.bytes[b] for b in c.encode("utf-8"))

    def forward(self, words: list[bytes]) -> tuple[Arcs, np.ndarray, np.ndarray]:
        """(arcs, their log weights, log probability of all ways from a word's first node to each node)."""
        arcs = Arcs(words, self.automaton, self.size)
        kinds, which = np.unique(arcs.code, return_inverse=True)
        spelled = np.array([self.spell(chr(c)) for c in kinds])[which]
        w = np.where(arcs.piece >= 0, self.weight[arcs.piece], spelled[arcs.start])
        a = np.zeros(len(arcs.code) + 1)
        for lo, hi, first, beyond in zip(arcs.at[:-1].tolist(), arcs.at[1:].tolist(), arcs.group_at[:-1].tolist(), arcs.group_at[1:].tolist(), strict=True):
            t = a[arcs.start[lo:hi]] + w[lo:hi]
            heads = arcs.groups[first:beyond]
            most = np.maximum.reduceat(t, heads - lo)
            sizes = np.diff(np.append(heads, hi))
            a[arcs.end[heads]] = most + np.log(np.add.reduceat(np.exp(t - np.repeat(most, sizes)), heads - lo))
        return arcs, w, a

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the words' marginal probabilities."""
        out = np.full(len(words), self.end)
        real = [k for k, w in enumerate(words) if w != END]
        if real:
            arcs, _, a = self.forward([words[k] for k in real])
            out[real] = a[arcs.last]
        return out

    def expect(self, words: list[bytes], counts: Counter) -> None:
        """Adds the expected count of each piece (and of each byte, by number) in one of each word."""
        real = [w for w in words if w != END]
        counts[END] += len(words) - len(real)
        if not real:
            return
        arcs, w, a = self.forward(real)
        share = np.exp(a[arcs.start] + w - a[arcs.end])  # of the ways into an arc's end
        passed = np.zeros(len(a))
        passed[arcs.last] = 1.0
        for lo, hi in zip(arcs.at[-2::-1].tolist(), arcs.at[:0:-1].tolist(), strict=True):
            share[lo:hi] *= passed[arcs.end[lo:hi]]
            np.add.at(passed, arcs.start[lo:hi], share[lo:hi])
        whole = arcs.piece >= 0
        found = np.bincount(arcs.piece[whole], share[whole], len(self.names))
        for k in np.flatnonzero(found).tolist():
            counts[self.names[k]] += float(found[k])
        kinds, which = np.unique(arcs.code[arcs.start[~whole]], return_inverse=True)
        for c, n in zip(kinds.tolist(), np.bincount(which, share[~whole]).tolist(), strict=True):
            for b in chr(c).encode("utf-8"):
                counts[b] += n


def rebatched(batches: Iterator[pa.RecordBatch], rows: int = 8192, size: int = 1 << 20) -> Iterator[pa.Table]:
    """The batches in larger ones: of so many rows or bytes, if the last adds no more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


@lru_cache(maxsize=1)
def read_vocabulary(content: bytes) -> tuple[list[tuple[str, float]], dict[int, float]]:
    """(piece, Zipf weight by the file's score) and the weights of the 256 bytes, before normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    pieces, single = [], {}
    for k in range(model.get_piece_size()):
        if model.is_byte(k):
            single[int(model.id_to_piece(k)[3:5], 16)] = 1.0
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            pieces.append((model.id_to_piece(k), 1.0 / (10.0 - min(model.get_score(k), 0.0))))
    return pieces, {b: single.get(b, 1.0) for b in range(256)}


def weights(content: bytes, counts: dict, prior: float) -> tuple[list[tuple[str, float]], dict[int, float], float]:
    """Log weights of pieces, bytes and end from expected counts, with `prior` counts spread by the file's scores."""
    pieces, single = read_vocabulary(content)
    share = sum(w for _, w in pieces)
    # A thousandth of the prior for bytes, as much for the end.
    mass = {p: counts.get(p, 0.0) + 0.998 * prior * w / share for p, w in pieces}
    byte_mass = {b: counts.get(b, 0.0) + 0.001 * prior / 256 for b in single}
    end = counts.get(END, 0.0) + 0.001 * prior
    total = math.fsum(mass.values()) + math.fsum(byte_mass.values()) + end
    return [(p, math.log(m / total)) for p, m in mass.items()], {b: math.log(m / total) for b, m in byte_mass.items()}, math.log(end / total)


def score_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, prior: float = 1000.0, discount: float = 0.75, steps: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; both scores are log10 probabilities."""
    with open(model_path, "rb") as f:
        content = f.read()
    context = docs.sparkSession.sparkContext
    texts = id_and_text(docs, id_col, text_col)
    blocked = in_blocks(texts).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False)))
    named = blocked.groupBy("block").applyInArrow(_name, "block int, word binary, n long")
    words = durable(by_word(named))
    totals = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n_all, distinct = totals["n"] or 0, totals["v"] or 0

    model = context.broadcast(weights(content, {}, prior))  # as large as the vocabulary
    for _ in range(steps):
        expected = arrow_map(words.filter("n > 0").select("word"), _expectation(model), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        gathered = {(int(k[1:]) if k[0] == "b" else END if k == "e" else k[1:]): n for k, n in expected.collect()}  # as long as the vocabulary
        model = context.broadcast(weights(content, gathered, prior))
    piece_arcs = math.log(discount * distinct / n_all) if n_all else 0.0

    def likelihood(batches):
        lattice = Lattice(model.value)
        for table in rebatched(batches):
            logp = piece_arcs + lattice.log_probabilities(table.column(0).to_pylist())
            n = table.column(1).to_numpy()
            if n_all:
                whole = np.log(np.where(n > 0, n - discount, 1.0) / n_all)
                logp = np.where(n > 0, np.logaddexp(logp, whole), logp)
            yield from table.append_column("logp", pa.array(logp / LOG10, pa.float64())).to_batches()

    known = arrow_map(words.select("word", "n", "blocks"), likelihood, "word binary, n long, blocks array<int>, logp double")

    def documents(table: pa.Table, scored: pa.Table) -> pa.Table:
        at = {w: k for k, w in enumerate(scored.column("word").to_pylist())}
        n = scored.column("n").to_numpy()
        base = np.log10((n + 0.5) / (n_all + 0.5 * (distinct + 1)))
        logp = scored.column("logp").to_numpy()
        out: list[list] = [[], [], [], []]
        for t in unpacked(table):
            k = np.array([*map(at.__getitem__, words_of(t)), at[END]])
            for column, value in zip(out, (len(k), int((n[k] > 0).sum()), float(base[k].sum()), float(logp[k].sum())), strict=True):
                column.append(value)
        return pa.table([table.column("doc_id"), table.column("held_out"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([n_all] * len(table), pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return meet(blocked, known, documents, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _expectation(model):
    def expectation(batches):
        lattice, counts = Lattice(model.value), Counter()
        for table in rebatched(batches):
            lattice.expect(table.column(0).to_pylist(), counts)
        keys = [f"b{k}" if isinstance(k, int) else "e" if k == END else f"p{k}" for k in counts]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(counts.values()), pa.float64())], ["piece", "n"])

    return expectation


def _name(table: pa.Table) -> pa.Table:
    """Distinct words of a block, with their counts in its training texts."""
    counts: Counter = Counter()
    others: set[bytes] = set()
    for t, held in zip(unpacked(table), table.column("held_out").to_pylist(), strict=True):
        (others if held else counts).update(words_of(t))
        (others if held else counts).update((END,))
    found = {**dict.fromkeys(others, 0), **counts}
    block = table.column("block")[0].as_py()
    return pa.table([pa.array([block] * len(found), pa.int32()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["block", "word", "n"])
