"""Near-duplicate classes by an exact Jaccard join of word n-grams, through PartEnum signatures.

Equal texts are one class from the start. Every other pair is found by signatures:

* Sets are put into bands of size [l, l / t]; sets of Jaccard similarity t or more lie in one
  band or in neighbouring ones, so a set signs for its own band and for the next.
* For sets of a band the similarity bounds the symmetric difference by some k. The feature
  domain is hashed into n1 groups, so that some groups differ by at most one element, and
  each group into three partitions, of which two must then be equal. The signatures are the
  hashes of a set's elements in every two of three partitions of a group.
* The bound is taken by a set's own size: with k' for k, its first k' // 2 + 1 + d groups hold
  d + 1 groups that differ by at most one element. Signatures of no elements, which unrelated
  sets would share, are left out unless more than d groups have one; d follows from the band.

Sets that share a signature meet in its bucket. Buckets of the same members are one. In
rounds, a few leaders of each bucket (1, then 64, then 64 times as many) meet its other
members, where they are not yet in one component. Parity sketches, whose distance bounds the
symmetric difference from below, dismiss most pairs; the others are compared exactly.
Components are contracted; buckets within one component, and leaders that are done, go. So
near copies that one of them links cost one comparison each, and no link between different
components is ever lost: it ends when no bucket has two.

Words are split at ASCII white space, A-Z in lower case; a text with fewer words than the
width has its whole sequence as the one shingle; a null or empty text, or one without words,
has none and is linked with nothing. A very long text is one set, whole; pairs just at the
threshold are linked. Sets are of 64-bit hashes. Repeated rows each give a row
(the same id is one node, linked by each of its texts); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, durable, id_and_text, release, text_blocks
from .components import contract
from .lattice_lm import words_of

ODD = np.uint64(0x9E3779B97F4A7C15)
BITMAP_WORDS = 1 << 16
SKETCH = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        self[word] = h
        return h


_hashes = WordHashes()


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    if n < width:
        s = np.full(1, n, np.uint64)
        for k in range(n):
            s = mix(s * ODD + w[k : k + 1])
        return s
    s = w[: n - width + 1]
    for k in range(1, width):
        s = s * ODD + w[k : n - width + 1 + k]
    return np.unique(mix(s))


@lru_cache(maxsize=4096)
def band(size: int, percent: int) -> int:
    return _bands(percent, size)[1]


@lru_cache(maxsize=65536)
def _bands(percent: int, size: int) -> tuple[int, int]:
    low, k = 1, 0
    while (high := max(low, low * 100 // percent)) < size:
        low, k = high + 1, k + 1
    return low, k


@lru_cache(maxsize=4096)
def bounds(k: int, percent: int) -> tuple[int, int]:
    """The least and greatest size of band k."""
    low = 1
    for _ in range(k):
        low = max(low, low * 100 // percent) + 1
    return low, max(low, low * 100 // percent)


def difference(a: int, b: int, percent: int) -> int:
    """The greatest symmetric difference of sets of sizes a and b of that similarity."""
    return (100 - percent) * (a + b) // (100 + percent)


@lru_cache(maxsize=4096)
def plan(tag: int, percent: int) -> tuple[int, int, int]:
    """(greatest size, groups n1, spare groups d) of a tag: bands tag - 1 and tag."""
    high = bounds(tag, percent)[1]
    low = bounds(max(tag - 1, 0), percent)[0]
    k = difference(high, high, percent)
    if k == 0:
        return high, 1, 0
    groups = k // 2 + 1
    own = difference(low, min(low * 100 // percent, high), percent) // 2 + 1
    expected = 3 * own * math.exp(-2 * low / (3 * groups))
    d = math.ceil(expected + 3 * math.sqrt(expected)) if groups > 1 else 0
    return high, groups + d, d


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set of hashes, for its own band and the next."""
    size, out = len(h), []
    if not size:
        return np.empty(0, np.uint64)
    own = band(size, percent)
    for tag in (own, own + 1):
        high, groups, d = plan(tag, percent)
        k = difference(size, min(size * 100 // percent, high), percent)
        seed = mix(np.full(1, tag + 1, np.uint64))
        if difference(high, high, percent) == 0:
            out.append(mix(np.full(1, h.sum(), np.uint64) ^ seed))
            continue
        prefix = min(k // 2 + 1 + d, groups)
        place = mix(h ^ seed)
        group = (place >> np.uint64(32)) % np.uint64(groups)
        inside = group < prefix
        cell = (group[inside] * np.uint64(3) + (place[inside] & np.uint64(0xFFFF)) % np.uint64(3)).astype(np.int64)
        value = mix(h[inside] * ODD)
        n = 3 * prefix
        count = np.bincount(cell, minlength=n).reshape(-1, 3)
        # Exact sums of 32-bit halves, then one 64-bit sum modulo 2 ** 64.
        low_half = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
        high_half = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
        part = (mix(low_half) + high_half * ODD + low_half).reshape(-1, 3)
        name = mix(np.arange(n, dtype=np.uint64).reshape(-1, 3) * ODD + seed)
        two = mix(part[:, (1, 2, 0)] + mix(part[:, (2, 0, 1)] + ODD)) ^ name
        filled = (count[:, (1, 2, 0)] + count[:, (2, 0, 1)]) > 0
        weak = int((~filled).any(axis=1).sum())
        out.append(two[filled] if weak <= d else two.ravel())
    return np.concatenate(out)


def _signed(width: int, percent: int):
    def sign(batches):
        for ids, texts in text_blocks(batches):
            for at in range(0, len(ids), 64):
                parts = [signatures(shingles(t, width), percent) for t in texts[at : at + 64]]
                docs = np.repeat(np.asarray(ids[at : at + 64], np.int64), [len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(docs)], ["sig", "doc"])

    return sign


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCH bits: of the elements hashed to each whether they are odd in number.

    An element in one of two sets only flips one bit, so the sketches of two sets differ in
    at most as many bits as the sets differ in elements.
    """
    place = (mix(h + ODD) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _sets(width: int):
    def sets(batches):
        for ids, texts in text_blocks(batches):
            for at in range(0, len(ids), 64):
                own = [shingles(t, width) for t in texts[at : at + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 64], pa.int64()), pa.array([len(h) for h in own], pa.int64()), pa.array([sketch(h) for h in own], pa.list_(pa.int64())), pa.array([h.tobytes() for h in own], pa.binary())], ["doc", "size", "sketch", "set"])

    return sets


def _linked(percent: int):
    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return linked


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts whose doc_id is in wanted (doc). A bitmap of fixed size spares most others the shuffle of the exact join."""
    bits = 64 * BITMAP_WORDS
    slots = wanted.select(F.pmod(F.xxhash64("doc"), F.lit(bits)).alias("slot"))
    rows = slots.selectExpr("cast(slot div 64 as int) AS w", "shiftleft(1L, cast(slot % 64 AS int)) AS bit").groupBy("w").agg(F.bit_or("bit").alias("bits")).collect()
    bitmap = [0] * BITMAP_WORDS
    for r in rows:
        bitmap[r["w"]] = r["bits"]
    literal = F.from_json(F.lit(str(bitmap)), "array<bigint>")
    here = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    hit = F.call_function("shiftright", F.get(literal, (here / 64).cast("int")), (here % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return texts.filter(hit).join(wanted.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")


def near_classes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, comp) of those documents of an id_and_text table that share a bucket; comp: of linked ones alike."""
    signed = arrow_map(texts, _signed(width, percent), "sig long, doc long")
    bucket = Window.partitionBy("sig")
    met = durable(signed.select("sig", "doc", F.count("*").over(bucket).alias("n"), F.min("doc").over(bucket).alias("least"), F.max("doc").over(bucket).alias("most"), F.bit_xor(F.xxhash64("doc")).over(bucket).alias("members")).filter("least < most"))
    release(texts.sparkSession)  # of all signatures
    alike = met.groupBy("least", "n", "members").agg(F.min("sig").alias("sig"))
    kept = met.join(alike.select("sig"), "sig", "left_semi").select("sig", "doc", "n").distinct()
    # Whoever meets the most others leads its buckets: of near copies, the one most like the rest.
    reach = kept.groupBy("doc").agg(F.sum("n").alias("reach"))
    rows = durable(kept.join(reach, "doc").select("sig", "doc", "reach"))
    del met, alike, kept, reach
    release(texts.sparkSession)

    nodes = durable(rows.select("doc").distinct().withColumn("comp", F.col("doc")))
    sets = durable(arrow_map(_only(texts, nodes), _sets(width), "doc long, size long, sketch array<long>, set binary"))
    release(texts.sparkSession)
    bits = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(SKETCH // 64))
    # Exact in that it holds for every link: sketches and sizes differ less than the sets may.
    near = F.expr(f"{bits} <= ({100 - percent} * (x.size + y.size)) div {100 + percent} AND 100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)")
    seen = None
    leaders = 1
    while True:
        placed = rows.join(nodes, "doc")
        live = placed.select("*", F.min("comp").over(bucket).alias("c0"), F.max("comp").over(bucket).alias("c1"), F.row_number().over(bucket.orderBy(F.desc("reach"), "doc")).alias("rank")).filter("c0 <> c1")
        rows = durable(live.withColumn("leads", F.col("rank") <= leaders).select("sig", "doc", "reach", "comp", "leads"))
        if rows.isEmpty():
            return nodes
        marked = rows.join(sets.select("doc", "size", "sketch"), "doc")
        pairs = marked.filter("leads").alias("x").join(marked.alias("y"), "sig").filter(near & F.expr("x.doc <> y.doc AND x.comp <> y.comp")).select(F.expr("least(x.doc, y.doc)").alias("a"), F.expr("greatest(x.doc, y.doc)").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        whole = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
        judged = durable(arrow_map(whole.select("a", "b", "set_a", "set_b"), _linked(percent), "a long, b long, linked boolean"))
        seen = judged.select("a", "b") if seen is None else durable(seen.unionByName(judged.select("a", "b")))
        of = lambda side: nodes.select(F.col("doc").alias(side), F.col("comp").alias(f"c{side}"))
        links = judged.filter("linked").join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        nodes = contract(nodes, links)
        rows = rows.filter("not leads").select("sig", "doc", "reach")
        leaders *= 64


def ngram_components(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    texts = id_and_text(docs, id_col, text_col)
    repeats = _repeats(texts)
    text_class = [F.xxhash64("text").alias("h"), F.sha2("text", 256).substr(1, 16).alias("s"), F.octet_length("text").alias("len")]
    worded = texts.filter(F.col("doc_id").isNotNull() & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    marks = worded.select("doc_id", *text_class)
    # A text's class: its least id; only that document goes on. Where an id has several texts, classes are numbered instead.
    least = marks.groupBy("h", "s", "len").agg(F.min("doc_id").alias("rep"))
    least = durable(least.withColumn("node", F.monotonically_increasing_id())) if repeats else least.withColumn("node", F.col("rep"))
    classes = durable(marks.join(least, ["h", "s", "len"]).select("doc_id", "node"))
    if repeats:
        distinct = worded.select(F.col("doc_id").alias("rep"), "text", *text_class).join(least, ["h", "s", "len", "rep"]).select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    else:
        distinct = texts.join(classes.filter("doc_id = node").select("doc_id"), "doc_id", "left_semi")
    nodes = near_classes(distinct.select("doc_id", "text"), width, percent)
    named = classes.join(nodes.select(F.col("doc").alias("node"), "comp"), "node", "left").select("doc_id", F.coalesce("comp", "node").alias("comp"))
    if repeats:
        named = _united(durable(named.distinct()))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = named.join(smallest, "comp").select("doc_id", "component_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))

    def sizes(batches):
        for ids, block in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(shingles(t, width)) for t in block], pa.int64())], ["doc_id", "n_shingles"])

    return arrow_map(texts, sizes, "doc_id long, n_shingles long").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _united(named: DataFrame) -> DataFrame:
    """(doc_id, comp) with the components of each id made one."""
    links = named.join(named.groupBy("doc_id").agg(F.min("comp").alias("b")), "doc_id").select(F.col("comp").alias("a"), "b")
    comps = contract(named.select(F.col("comp").alias("doc"), "comp").distinct(), links)
    return named.withColumnRenamed("comp", "doc").join(comps, "doc").select("doc_id", "comp")


def _repeats(texts: DataFrame) -> bool:
    """Whether an id occurs twice."""
    return not texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
