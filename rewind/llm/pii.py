"""Personal data by base patterns and a skip-chain conditional random field.

Base kinds (email, ip, card, phone) are found by their patterns and always stay. The field
adds what the patterns miss. Its nodes are a text's candidate tokens: runs of letters,
digits and `._%+@-` of four characters or more that hold a digit or an @ (any other token is
outside by definition). Potentials:

* a node's shape and surroundings,
* transitions between candidates that follow each other closely, once for each two tokens,
* skip edges, at any distance, which share a potential for equal labels: from each mention
  of a repeated token to one node of that token, and from a token to the last of equal shape.

The node of a repeated token holds the evidence of its shape and of the surroundings of all
its mentions, each feature once, so that many like mentions don't outvote one. Nodes inside base spans are observed. Loopy message passing
(sum-product, damped, until no message moves, and for longer than the longest path) gives
the marginals of the others, so that evidence at one mention, such as an assignment to a
word like "token", labels the mentions without it, however many. An unobserved node whose
likeliest label is not "outside" and has at least `CONFIDENT` of the marginal becomes a span
of that kind.

The field is trained by pseudo-likelihood on silver labels (base patterns, and assignments
to a word for a secret, which hold for each mention of the secret) of at most about
`max_train_docs` texts drawn by a hash of id and text; at most `max_nodes` candidates of a text, drawn
by a hash of text and position (so the driver holds at most their product of rows, 56 MB);
context features are hidden in half of the training nodes, so that shapes learn to stand
alone, and the potential of token nodes comes from how often mentions agree with theirs. A
text with n candidates has at most 3 n edges; a round of messages takes time in n.

Nulls and empty texts hold nothing; a text is read whole however long; of labels equally
likely the first listed is taken; repeated rows each give a row; without any candidate in
the drawn texts only base spans are given; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, text_blocks

BASE = ("email", "ip", "card", "phone")
LABELS = ("outside", *BASE, "secret")
CONFIDENT, NEAR, STILL = 0.6, 24, 1e-3

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_token = _local | {"@"}
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Equal to the plain pattern: a run of digits that fails from its start fails from within.
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_marks = re.compile(r"[0-9@]+")
_assigned = re.compile(r"(?i)(token|key|secret|passw(or)?d|pwd|auth|api)\s{0,3}[=:]\s{0,3}[\"']?\Z")
_hex = re.compile(r"[0-9a-fA-F]+\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind as listed, then start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _card.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the candidate tokens."""
    out, after = [], 0
    for m in _marks.finditer(text):
        start, end = m.span()
        if end <= after:
            continue
        while start > after and text[start - 1] in _token:
            start -= 1
        while end < len(text) and text[end] in _token:
            end += 1
        after = end
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not text[start].isalnum() and text[start] != "+":
            start += 1
        if end - start >= 4:
            out.append((start, end))
    return out


FEATURES = ("bias", "assigned", "quoted", "at", "dots3", "octets", "plus", "digits_only", "luhn", "hex", "mixed", "len4", "len8", "len13", "len20", "len32", "paren_before", "digit_before", "many_digits", "upper")
CONTEXT = (1, 2, 16, 17)


def features(text: str, start: int, end: int) -> np.ndarray:
    token, before = text[start:end], text[max(0, start - 24) : start]
    n = end - start
    digits = sum(c.isdigit() for c in token)
    parts = token.split(".")
    plain = token.isdigit() and token.isascii()
    on = (
        True, bool(_assigned.search(before)), before[-1:] in ("'", '"'), "@" in token, len(parts) == 4 and all(p.isdigit() for p in parts),
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts), token[0] == "+", plain, plain and 13 <= n <= 19 and luhn(token),
        n >= 16 and not plain and bool(_hex.match(token)), 0 < digits < n and token.isalnum(), n < 8, 8 <= n < 13, 13 <= n < 20, 20 <= n < 32, n >= 32,
        before.endswith(("(", ") ", ")")), before[-1:].isdigit() or before[-2:-1].isdigit(), digits > n / 2, token.isupper(),
    )
    return np.asarray(on, float)


def shape(token: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", token)) + str(len(token) // 4)


class Graph:
    """Candidates of a text and, after them, a node for each repeated token; features, observed labels and edges (later, earlier, kind)."""

    def __init__(self, text: str, base: list[tuple[str, int, int]] | None = None):
        self.base = base_spans(text) if base is None else base
        self.spans = candidates(text)
        self.x = np.array([features(text, s, e) for s, e in self.spans]).reshape(-1, len(FEATURES))
        taken = sorted((s, e, LABELS.index(k)) for k, s, e in self.base)
        self.observed = []
        k = 0
        for s, e in self.spans:
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            own = [t for t in taken[k : k + 4] if t[0] < e and t[1] > s]
            self.observed.append(own[0][2] if own else -1)
        tokens = [text[s:e].lower() for s, e in self.spans]
        mentions = Counter(tokens)
        self.token_of = [-1] * len(tokens)  # a mention's token node
        node: dict[str, int] = {}
        alike: dict[str, int] = {}
        self.edges = []
        own, follows = [], set()
        for i, ((s, e), token) in enumerate(zip(self.spans, tokens, strict=True)):
            if i and s - self.spans[i - 1][1] <= NEAR and tokens[i - 1] != token and (tokens[i - 1], token) not in follows:
                self.edges.append((i, i - 1, 0))
                follows.add((tokens[i - 1], token))
            if token not in node:
                node[token] = i
                if mentions[token] > 1:
                    node[token] = len(tokens) + len(own)
                    own.append(i)
                look = shape(token)
                if look in alike:
                    self.edges.append((node[token], alike[look], 2))
                alike[look] = node[token]
            if mentions[token] > 1:
                self.token_of[i] = node[token]
                self.edges.append((node[token], i, 1))
        # A repeated token's features are on in its node if they are at any mention.
        place = np.array(self.token_of, int).reshape(-1)
        self.node_x = np.vstack([self.x, np.zeros((len(own), len(FEATURES)))])
        np.maximum.at(self.node_x, place[place >= 0], self.x[place >= 0])
        self.node_x[: len(place)][place >= 0] = 0

    def silver(self) -> np.ndarray:
        """Labels of all nodes by the base patterns and by assignment, which holds for each mention."""
        y = [o if o > 0 else 5 if x[1] and x[15] + x[14] > 0 else 0 for o, x in zip(self.observed, self.x, strict=True)]
        of: dict[int, Counter] = {}
        for t, k in zip(self.token_of, y, strict=True):
            if t >= 0:
                of.setdefault(t, Counter())[k] += 1
        named = {t: 5 if c[5] else min(c, key=lambda k: (-c[k], k)) for t, c in of.items()}
        y = [5 if k == 0 and named.get(t) == 5 else k for t, k in zip(self.token_of, y, strict=True)]
        return np.array(y + [named[t] for t in sorted(named)], int)


class Field:
    """unary: features x labels; chain: labels x labels (earlier, later); agree: potentials of equal labels over the two kinds of skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, agree: tuple[np.ndarray, np.ndarray]):
        self.unary, self.chain, self.agree = unary, chain, agree

    def pair(self, kind: int) -> np.ndarray:
        return self.chain if kind == 0 else np.diag(self.agree[kind - 1])

    def marginals(self, g: Graph) -> np.ndarray:
        """Of each candidate."""
        n, m = len(g.spans), len(LABELS)
        score = g.node_x @ self.unary
        for i, o in enumerate(g.observed):
            if o >= 0:
                score[i] = np.where(np.arange(m) == o, 0.0, -30.0)
        if g.edges:
            later, earlier, kind = map(np.array, zip(*g.edges, strict=True))
            potential = np.exp(np.stack([self.pair(k) for k in range(3)]))[kind]  # edge, earlier, later
            down, up = np.zeros((len(later), m)), np.zeros((len(later), m))
            # Damped messages take two rounds an edge; no path is longer than the number of nodes.
            for _ in range(2 * len(score) + 50):
                belief = score.copy()
                np.add.at(belief, later, down)
                np.add.at(belief, earlier, up)
                a, b = belief[earlier] - up, belief[later] - down
                a, b = np.exp(a - a.max(axis=1, keepdims=True)), np.exp(b - b.max(axis=1, keepdims=True))
                new_down = np.log(np.einsum("ei,eij->ej", a, potential) + 1e-300)
                new_up = np.log(np.einsum("ej,eij->ei", b, potential) + 1e-300)
                new_down -= new_down.max(axis=1, keepdims=True)
                new_up -= new_up.max(axis=1, keepdims=True)
                moved = max(np.abs(new_down - down).max(), np.abs(new_up - up).max())
                down, up = (down + new_down) / 2, (up + new_up) / 2
                if moved < STILL:
                    break
            np.add.at(score, later, down)
            np.add.at(score, earlier, up)
        score = score[:n]
        p = np.exp(score - score.max(axis=1, keepdims=True)) if n else score
        return p / p.sum(axis=1, keepdims=True)


def training_rows(text: str) -> list[tuple[list[float], int, list[float]]]:
    """(features, silver label, counts of neighbours' labels by edge kind) of each candidate."""
    g = Graph(text)
    y, m = g.silver(), len(LABELS)
    around = np.zeros((len(y), 4 * m))  # chain from before, chain from after, same, similar
    for i, j, kind in g.edges:
        for node, other, block in ((i, j, 0 if kind == 0 else kind + 1), (j, i, 1 if kind == 0 else kind + 1)):
            around[node, block * m + y[other]] += 1
    return [(list(x), int(k), list(a)) for x, k, a in zip(g.x, y, around, strict=False)]  # token nodes come after the candidates


def drawn_rows(text: str, most: int) -> list[tuple[list[float], int, list[float]]]:
    """At most so many training rows of a text, drawn by a hash of text and position."""
    rows, seed = training_rows(text), zlib.crc32(text.encode("utf-8", "surrogatepass"))
    order = sorted(range(len(rows)), key=lambda k: (zlib.crc32(b"%d" % k, seed), k))
    return [rows[k] for k in sorted(order[:most])]


def fit_field(x: np.ndarray, y: np.ndarray, around: np.ndarray, rounds: int = 400, ridge: float = 1e-3, seed: int = 3) -> Field:
    """Pseudo-likelihood by gradient steps, context features hidden in half of the rows; the potential of token nodes from how often mentions agree with theirs."""
    m = len(LABELS)
    hide = np.random.default_rng(seed).random(len(x)) < 0.5
    x = x.copy()
    x[np.ix_(hide, CONTEXT)] = 0
    weight = 1 / np.maximum(np.bincount(y, minlength=m), 1)[y] ** 0.5
    weight /= weight.sum()
    unary, chain, agree = np.zeros((x.shape[1], m)), np.zeros((m, m)), np.zeros(m)
    before, after, same, alike = (around[:, k * m : (k + 1) * m] for k in range(4))
    size = [np.full(a.shape, 1e-8) for a in (unary, chain, agree)]
    for _ in range(rounds):
        score = x @ unary + before @ chain + after @ chain.T + alike * agree
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        steps = (x.T @ p + ridge * unary, before.T @ p + p.T @ after + ridge * chain, (alike * p).sum(axis=0) + ridge * agree)
        for a, g, s in zip((unary, chain, agree), steps, size, strict=True):
            s += g * g
            a -= 0.3 * g / np.sqrt(s)
    equal, all_same = same[np.arange(len(y)), y].sum(), same.sum()
    tie = math.log((equal + 0.5) / ((all_same - equal) / (m - 1) + 0.5))
    return Field(unary, chain, (np.full(m, max(tie, 0.0)), np.maximum(agree, 0)))


def fit(docs: DataFrame, *, max_train_docs: int = 20_000, max_nodes: int = 16, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """A field trained on silver labels of about max_train_docs texts, max_nodes of each; None without a candidate.

    What is drawn and the fit depend on the set of rows alone: rows equal in id and text count once, and training rows are sorted.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("at", F.xxhash64("doc_id", "text"))
    n = texts.count()
    bound = int(min(1.0, max_train_docs / max(n, 1)) * (1 << 30))

    def rows(batches):
        for batch in batches:
            found = [(at, k, r) for at, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, r in enumerate(drawn_rows(t, max_nodes))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2][1] for f in found], pa.int32()), pa.array([f[2][0] for f in found], pa.list_(pa.float32())), pa.array([f[2][2] for f in found], pa.list_(pa.float32()))], ["at", "k", "y", "x", "around"])

    # Rows that are equal share a place: however often one is repeated, it is drawn once.
    drawn = texts.filter(F.pmod("at", F.lit(1 << 30)) < bound).groupBy("at").agg(F.min("text").alias("text"))
    table = arrow_map(drawn, rows, "at long, k int, y int, x array<float>, around array<float>").toArrow().sort_by([("at", "ascending"), ("k", "ascending")]).combine_chunks()
    if not table.num_rows:
        return None
    matrix = lambda c: table.column(c).combine_chunks().flatten().to_numpy().astype(float).reshape(table.num_rows, -1)
    return fit_field(matrix("x"), table.column("y").to_numpy(), matrix("around"))


def find(text: str, field: Field | None) -> list[tuple[str, int, int]]:
    """All spans, base ones first, by kind and start."""
    base = base_spans(text)
    if field is None or not _marks.search(text):
        return base
    g = Graph(text, base)
    if not g.spans or min(g.observed) >= 0:
        return base
    p = field.marginals(g)
    best = p.argmax(axis=1)
    added = [(LABELS[k], s, e) for (s, e), k, o, row in zip(g.spans, best, g.observed, p, strict=True) if o < 0 and k > 0 and row[k] >= CONFIDENT]
    return sorted(base + added, key=lambda x: (LABELS.index(x[0]), x[1]))


def spans(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and found: arrays of (kind, start, end) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def located(batches):
        asdict = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]
        for ids, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([asdict(base_spans(t)) for t in texts], kind), pa.array([asdict(find(t, shared.value)) for t in texts], kind)], ["doc_id", "base", "found"])

    struct = "array<struct<kind:string,start:int,end:int>>"
    return arrow_map(id_and_text(docs, id_col, text_col), located, f"doc_id long, base {struct}, found {struct}")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def redact(text: str, field: Field | None) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first."""
    out, at = [], 0
    for kind, start, end in sorted(find(text, field), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])
