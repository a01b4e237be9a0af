"""Toxicity by weak supervision.

1. Draw: labels alone give at most `max_train_rows` training ids, by a hash of the id, toxic
   ones up to half of them. The list is broadcast, so no text is shuffled but those of
   the drawn rows, of which one is kept for each id (the least, where an id has several).
2. Lexicons: document counts of words and word stems (first four to seven letters) by label
   give the features most typical of toxic texts, dealt to `LEXICONS` disjoint lexicons.
   They are learned from the labels, as the vocabulary of the classifier is.
3. Voters: one per lexicon (toxic on a hit, else silent), some on the number, density and
   absence of hits, pattern voters that know no lexicon (shouting, exclaiming, masked words,
   drawn-out letters, symbols), and the label itself, as one more voter that can err.
4. Label model: two classes; given the class each voter depends on one other, its parent in
   the tree of greatest conditional mutual information. The tables P(vote | class, parent's
   vote) are the accuracies and correlations; expectation-maximisation estimates them.
5. A linear classifier on the presence of chosen words and stems and on counts of hits learns
   the label model's posteriors, by full gradient steps with an L2 penalty.

Labels only come from rows whose crc32(doc_id as text) mod `folds` is not `held_fold`. They,
language, source and id are no inputs of a score. Every step is a function of the set of
drawn rows, not of their order or partitions.

Whole texts are read however long, in time linear in them. Nulls and empty texts get the
classifier's intercept; without training labels of both kinds, or any word that leans to
toxic texts, every score is 0; repeated rows each give a row; ties between features are
broken by their names; a null id is never held out and never trains; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, id_and_text, text_blocks

LEXICONS, LEXICON_SIZE, VOCABULARY = 16, 256, 4096
#: A lexicon feature needs evidence (twice the log likelihood ratio) of so many times the logarithm of the number of texts, and is so many times as frequent in toxic ones.
EVIDENCE, MIN_RATIO = 2.5, 4.0
HITS = (1, 2, 3, 5)
_words = re.compile(r"[^\W\d_]+").findall
_masked = re.compile(r"[^\W\d_][*#@$%]+[^\W\d_]")
_drawn_out = re.compile(r"([^\W\d_])\1\1\1")
_symbols = re.compile(r"[#*$%&|<>]")


def word_features(word: str) -> tuple[str, ...]:
    """A word and its stems."""
    return (word, *(f"{word[:k]}~" for k in (4, 5, 6, 7) if len(word) > k))


def held_out(folds: int, held_fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))


class Known(dict):
    """word -> (places in the vocabulary, lexicons hit), or () for a word with neither; bounded."""

    def __init__(self, place: dict[str, int], lexicon: dict[str, int]):
        super().__init__()
        self.place, self.lexicon = place, lexicon

    def __missing__(self, w: str):
        features = word_features(w)
        own = tuple([self.place[f] for f in features if f in self.place])
        hits = tuple([self.lexicon[f] for f in features if f in self.lexicon])
        if len(self) >= 300_000:
            self.clear()
        self[w] = found = (own, hits) if own or hits else ()
        return found


class Reader:
    """Features and votes of texts, given the lexicons (feature -> lexicon) and the vocabulary (feature -> place)."""

    def __init__(self, lexicon: dict[str, int], place: dict[str, int]):
        self.known, self.base = Known(place, lexicon), len(place)

    def read(self, text: str) -> tuple[set[int], int, set[int], int]:
        """(places of the linear model, hit words, lexicons hit, words)."""
        counts = Counter(_words(text.lower()))
        places: set[int] = set()
        hit_words, lexicons = 0, set()
        for w, found in zip(counts, map(self.known.__getitem__, counts), strict=True):
            if found:
                places.update(found[0])
                if found[1]:
                    hit_words += counts[w]
                    lexicons.update(found[1])
        places.update(self.base + i for i, k in enumerate(HITS) if hit_words >= k)
        places.update(self.base + len(HITS) + i for i, k in enumerate(HITS) if len(lexicons) >= k)
        return places, hit_words, lexicons, counts.total()

    def votes(self, text: str, hit_words: int, lexicons: set[int], n: int) -> list[int]:
        """1 toxic, -1 clean, 0 silent."""
        upper, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
        out = [int(k in lexicons) for k in range(LEXICONS)]
        out += [int(len(lexicons) >= 2), int(hit_words >= 4), int(hit_words > 0.01 * n), -int(not hit_words and n >= 20)]
        return out + [int(2 * upper > letters), int(text.count("!") > n / 4), int(bool(_masked.search(text))), int(bool(_drawn_out.search(text))), int(len(_symbols.findall(text)) > n / 10)]


class Model:
    """Lexicons, vocabulary, weights and intercept; none depends on the size of the corpus. Without an intercept every score is 0."""

    def __init__(self, lexicon: dict[str, int], place: dict[str, int], weights: np.ndarray, bias: float | None):
        self.lexicon, self.place, self.weights, self.bias = lexicon, place, weights, bias


class Scorer:
    """The linear model over texts."""

    def __init__(self, model: Model):
        self.reader, self.weights, self.bias = Reader(model.lexicon, model.place), model.weights.tolist(), model.bias

    def score(self, text: str) -> float:
        if self.bias is None:
            return 0.0
        places = self.reader.read(text)[0]
        pull = math.fsum([self.weights[p] for p in places]) + self.bias
        return 1 / (1 + math.exp(-pull)) if pull > -500 else 0.0


def draw(labels: DataFrame, *, folds: int, held_fold: int, most: int, id_col: str, label_col: str) -> tuple[list[tuple[int, int]], int, int]:
    """At most so many (id, toxic) of the training folds, and the numbers of toxic and clean ids there."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(folds, held_fold))
    ordered = marks.withColumn("at", F.xxhash64("doc_id"))
    pick = lambda kind, n: [(r[0], kind) for r in ordered.filter(F.col("toxic") == kind).orderBy("at", "doc_id").limit(n).select("doc_id").collect()]  # noqa: E731  at most n ids
    counts = dict(marks.groupBy("toxic").count().collect())
    toxic = pick(1, most // 2)
    return toxic + pick(0, most - len(toxic)), counts.get(1, 0), counts.get(0, 0)


def feature_counts(train: DataFrame) -> DataFrame:
    """(feature, toxic, clean): document counts by label of a drawn sample (text, toxic)."""

    def count(batches):
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[t].update({f for w in set(_words(text.lower())) for f in word_features(w)})
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][f] for f in names], pa.int64()), pa.array([found[0][f] for f in names], pa.int64())], ["feature", "toxic", "clean"])

    return arrow_map(train.select("text", "toxic"), count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, int], dict[str, int]]:
    """(feature -> lexicon, feature -> place in the vocabulary) by the evidence of document counts of n_toxic and n_clean texts."""
    share = F.lit(n_toxic / (n_toxic + n_clean))
    n = F.col("toxic") + F.col("clean")
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))
    evidence = 2 * (part(F.col("toxic"), n * share) + part(F.col("clean"), n * (1 - share)))
    ratio = ((F.col("toxic") + 0.5) / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    ranked = counts.filter(n >= 3).select("feature", "toxic", "clean", F.round(evidence, 9).alias("evidence"), ratio.alias("ratio")).orderBy(F.desc("evidence"), "feature").limit(VOCABULARY).collect()  # at most VOCABULARY rows
    leaning = [r for r in ranked if r["ratio"] > 1 and r["toxic"] > 1]
    # Few or noisy labels may leave no typical feature: then the best of all that lean to toxic.
    typical = [r for r in leaning if r["evidence"] >= EVIDENCE * math.log(n_toxic + n_clean) and r["ratio"] >= MIN_RATIO] or leaning[:LEXICONS]
    kept: dict[str, tuple[int, int]] = {}
    for f, toxic, clean, *_ in typical:
        stem = f.rstrip("~")
        if all(kept.get(s) != (toxic, clean) for k in range(4, len(stem) + 3) for s in (stem[:k], f"{stem[:k]}~")) and not any(n == (toxic, clean) and g.startswith(stem) for g, n in kept.items()):
            kept[f] = (toxic, clean)  # else the same documents speak again
    return {f: k % LEXICONS for k, f in enumerate(list(kept)[:LEXICON_SIZE])}, {r["feature"]: k for k, r in enumerate(ranked)}


def voter_tree(level: np.ndarray, posterior: np.ndarray, weight: np.ndarray, least: float = 1e-4) -> list[int]:
    """Each voter's parent (-1: none) in the tree of greatest mutual information given the class; level: value, row, voter.

    An edge has at least that information (in nats).
    """
    m = level.shape[2]
    flat = level.transpose(1, 2, 0).reshape(level.shape[1], -1)  # row, voter x value
    information = np.zeros((m, m))
    for q in (posterior * weight, (1 - posterior) * weight):
        joint = ((flat * q[:, None]).T @ flat).reshape(m, 3, m, 3).transpose(0, 2, 1, 3) + 0.1 / 9
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        apart = joint.sum(axis=3, keepdims=True) * joint.sum(axis=2, keepdims=True)
        information += q.sum() / weight.sum() * (joint * np.log(joint / apart)).sum(axis=(2, 3))
    information = np.round(information, 9)
    parent, best = [-1] * m, information[0].copy()
    to, outside = np.zeros(m, int), set(range(1, m))
    while outside:
        i = min(outside, key=lambda k: (-best[k], k))
        outside.discard(i)
        parent[i] = int(to[i]) if best[i] >= least else -1
        closer = information[i] > best
        best, to = np.where(closer, information[i], best), np.where(closer, i, to)
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, weight: np.ndarray, balance: float, rounds: int = 12) -> np.ndarray:
    """Posterior probability of toxic of each row of votes (-1, 0, 1), by EM over the tree of voters from a first guess."""
    n, m = votes.shape
    level = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    code = (votes + 1).astype(int)
    posterior = start
    for k in range(rounds):
        if k in (0, rounds // 2):
            parent = voter_tree(level, posterior, weight)
        pull = np.full(n, math.log(balance / (1 - balance)))
        for i, p in enumerate(parent):
            tables = []
            for q in ((1 - posterior) * weight, posterior * weight):
                alone = level[:, :, i] @ q + 1 / 3
                alone /= alone.sum()
                if p < 0:
                    tables.append(np.log(alone)[None].repeat(3, 0))
                else:  # a parent's rare vote falls back on the voter alone
                    joint = (level[:, :, p] * q) @ level[:, :, i].T + 4 * alone
                    tables.append(np.log(joint / joint.sum(axis=1, keepdims=True)))
            above = code[:, p] if p >= 0 else np.zeros(n, int)
            pull += (tables[1] - tables[0])[above, code[:, i]]
        posterior = 1 / (1 + np.exp(-np.clip(pull, -30, 30)))
    return posterior


def fit_linear(rows: np.ndarray, places: np.ndarray, target: np.ndarray, weight: np.ndarray, size: int, steps: int = 200, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic loss on soft targets with an L2 penalty; rows, places: the entries that are 1."""
    n, every = len(target), size + 1  # the intercept is the last place
    rows, places = np.concatenate([rows, np.arange(n)]), np.concatenate([places, np.full(n, size)])
    ridge = np.append(np.full(size, penalty), 1e-3)
    scale = 1 / np.sqrt(0.25 * np.bincount(places, weight[rows], every) + ridge)
    forward = lambda v: np.bincount(rows, (v * scale)[places], n)
    back = lambda e: np.bincount(places, e[rows], every) * scale
    # The greatest curvature of the scaled loss, by power iteration, bounds the step; Nesterov's momentum.
    v = np.ones(every)
    for _ in range(20):
        v = back(0.25 * weight * forward(v)) + ridge * scale**2 * v
        curvature = float(np.linalg.norm(v))
        v /= curvature
    share = float((target * weight).sum() / weight.sum())
    w = np.zeros(every)
    w[size] = math.log((share + 1e-4) / (1 - share + 1e-4)) / scale[size]
    ahead, t = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(ahead), -30, 30)))
        new = ahead - (back((p - target) * weight) + ridge * scale**2 * ahead) / (1.05 * curvature)
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / new_t * (new - w), new, new_t
    w = w * scale
    return w[:size], float(w[size])


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_fold: int = 2, max_train_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most max_train_rows labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    nothing = Model({}, {}, np.zeros(0), None)
    ids, all_toxic, all_clean = draw(labels, folds=folds, held_fold=held_fold, most=max_train_rows, id_col=id_col, label_col=label_col)
    if not all_toxic or not all_clean:
        return nothing
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))  # at most max_train_rows ids
    # One text an id: however often an id is repeated, the sample stays bounded. Equal texts speak once.
    one = id_and_text(docs, id_col, text_col).join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    train = durable(one.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text"))
    drawn = dict(train.groupBy("toxic").count().collect())
    n_toxic, n_clean = drawn.get(1, 0), drawn.get(0, 0)
    if not n_toxic or not n_clean:
        return nothing
    lexicon, place = choose(feature_counts(train), n_toxic, n_clean)
    if not lexicon:
        return nothing
    shared = spark.sparkContext.broadcast((lexicon, place))  # at most VOCABULARY features

    def read(batches):
        reader = Reader(*shared.value)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                places, *hits = reader.read(text)
                found.append((sorted(places), reader.votes(text, *hits)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "places", "votes"])

    rows = arrow_map(train.select("doc_id", "text", "toxic"), read, "doc_id long, toxic int, places array<int>, votes array<int>").toArrow().sort_by("doc_id").combine_chunks()  # at most max_train_rows
    toxic = rows.column("toxic").to_numpy()
    votes = np.column_stack([np.asarray(rows.column("votes").to_pylist(), int).reshape(len(toxic), -1), 2 * toxic - 1])
    balance = float(np.clip(all_toxic / (all_toxic + all_clean), 0.001, 0.999))
    # Rows stand for the labelled ones they were drawn from.
    weight = np.where(toxic == 1, balance / n_toxic, (1 - balance) / n_clean) * len(toxic)
    target = label_model(votes, np.where(toxic == 1, 0.8, 0.03), weight, balance)
    lists = rows.column("places").to_pylist()
    entries = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    weights, bias = fit_linear(entries, np.fromiter((p for own in lists for p in own), np.int64, len(entries)), target, weight, len(place) + 2 * len(HITS))
    return Model(lexicon, place, weights, bias)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY features

    def scored(batches):
        scorer = Scorer(shared.value)
        for ids, texts in text_blocks(batches):
            out = [scorer.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())], ["doc_id", "score", "predicted"])

    return arrow_map(id_and_text(docs, id_col, text_col), scored, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_fold: int = 2, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, folds=folds, held_fold=held_fold, **options)
    return score(docs, model, threshold=threshold).select("doc_id", held_out(folds, held_fold).alias("held_out"), "score", "predicted")
