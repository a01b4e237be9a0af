"""The corpus operators against the libraries, brute force and round trips, on awkward rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from rewind.llm import bpe, lattice_lm, ngram_join, packing, pii, pretokens, quality, sharding, tiff, token_counts, toxicity
from rewind.llm.common import documents

SF = "/root/testdata/sf0.001"
SPACES = re.compile("[\x20\x09-\x0d]+")

ODD = [
    None, "", " ", "\n\n\t", "a", "one two three", "The  end<|endoftext|> of<|startoftext|>", "it's 12 o'clock, isn't it?!", "ÀÉÎÕÜ straße ΣΑΣ ſ İı", "zero​width ̄combining é é",
    "漢字かな交じり文 한국어 עברית العربية ไทย", "\U0001f600 emoji \U0002fa1d", "x" * 3000, "word " * 3000, "mail a@b.co, a@b.co_d@e.f 1.2.3.45.6.7.8 4111 1111 1111 1111 +1 (555) 555-5555",
    "token = \"0123456789abcdef0123456789abcdef01234567\" and 0123456789abcdef0123456789abcdef01234567", "͸ unassigned ๐१ digits", "nul \x00 byte",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "xx", "s", 1, "clash") for k, t in enumerate(ODD)] + [(100 + k, t, "xx", "s", 1, "clash") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def real(spark):
    return documents(spark, SF)


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_safe_classes_are_the_libraries_classes():
    import tiktoken

    for pattern, ranges in ((r"\p{L}", pretokens.LETTERS), (r"\p{N}", pretokens.NUMBERS), (r"\s", pretokens.SPACES)):
        e = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        for c in range(pretokens.SAFE_END):
            assert bool(re.match(f"[{ranges}]", chr(c))) == bool(e.encode_ordinary(chr(c))), hex(c)


def test_token_counts(odd, real, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for df in (odd, real):
        want = {k: len(t.encode(v, add_special_tokens=False).ids) for k, v in texts(df).items()}
        got = token_counts.token_counts(df, path, table_size=500, cache_bound=700).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0


def test_byte_shards(odd, real, empty):
    for df in (odd, real):
        got = sharding.byte_shards(df, 7).orderBy("shard", "slot").collect()
        t = texts(df)
        assert len(got) == len(t)
        assert [r.doc_id for r in got] == sorted(t)
        for r in got:
            assert (r.size, r.text_crc32) == (len(t[r.doc_id].encode()) + 16, zlib.crc32(t[r.doc_id].encode()))
        sizes, target = Counter(), sum(r.size for r in got) / 7
        for s, n in Counter(r.shard for r in got).items():
            own = [r for r in got if r.shard == s]
            assert [r.slot for r in own] == list(range(n))
            sizes[s] = sum(r.size for r in own)
        assert all(abs(v - target) <= max(r.size for r in got) for v in sizes.values())
    assert sharding.byte_shards(empty).count() == 0


def test_byte_bpe(spark, odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(odd, path, P.PATTERN, fold_limit=64).collect()
    t = texts(odd)
    assert len(got) == len(t)
    for r in got:
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == e.encode_ordinary(t[r.doc_id])
        assert bytes(r.decoded).decode() == t[r.doc_id]
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0
    words = spark.createDataFrame([(w,) for w in {b"hello" * 20, b"a" * 77, b"ab" * 30, b"abababa", b"\xff\xfe", b"x", b"", "éàé".encode() * 9, b"    ", b"Internationalisierung"}], "word binary")
    for r in words.select("word", bpe.encode_column(F.col("word"), ranks).alias("ids"), bpe.decode_column(bpe.encode_column(F.col("word"), ranks), ranks).alias("back")).collect():
        assert r.ids == (e._core_bpe.encode_single_piece(bytes(r.word)) if r.word else []) and r.back == r.word, r.word
    for w in (b"hello" * 200, b"a" * 777, "éàé".encode() * 99):
        assert bpe.merge_long(w, ranks) == e._core_bpe.encode_single_piece(w)


def test_byte_bpe_holds_a_batch_of_a_block(spark, monkeypatch):
    """A block goes back in batches, and its texts are not all unpacked at once."""
    import tracemalloc

    import pyarrow as pa

    parts = []
    monkeypatch.setattr(bpe, "meet", lambda blocked, known, fn, schema: parts.append((blocked, known, fn)))
    text = "abc de " * 2000
    bpe.encode_documents(spark.createDataFrame([(i, text) for i in range(2000)], "doc_id long, text string"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    (blocked, known, fn) = parts[0]
    table, encoded = blocked.filter("block = 0").toArrow().combine_chunks(), known.toArrow()
    fn(table.slice(0, 1), encoded)  # reads the vocabulary
    tracemalloc.start()
    out = fn(table, encoded)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == table.num_rows and max(b.num_rows for b in out.to_batches()) <= 256
    assert {bytes(d.as_buffer()).decode() for d in out.column("decoded")} == {text}
    assert peak < 0.8 * table.num_rows * len(text), peak
    assert out.schema.types == [pa.int64(), pa.binary(), pa.binary()]


def brute_quality(text):
    words = [w for w in SPACES.split(text) if w]
    lines = [s for s in text.split("\n") if SPACES.sub("", s)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + d for k, w in enumerate(windows) if w in many for d in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(odd, real, empty):
    for df in (odd, real):
        t = texts(df)
        for r in quality.quality_verdicts(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t[r.doc_id]), r.doc_id
            assert not (r.base_failed and r.kept)
    book = quality.ledger(real)
    failed = {r.rule: r.failed for r in quality.ablations(book).collect()}
    assert failed["too_few_words"] == sum(brute_quality(t)[0] < 50 for t in texts(real).values())
    assert quality.quality_verdicts(empty).count() == 0


def test_toxicity(spark, odd, real, empty):
    labels = documents(spark, SF, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(real, labels).collect()}
    assert set(got) == set(texts(real))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    none = labels.filter("false")
    assert all(r.score == 0 for r in toxicity.toxicity(odd, none).collect())
    assert toxicity.toxicity(empty, labels).count() == 0


def test_few_toxic_labels_still_score(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2][:60]
    rows = [(k, f"grimword vileword {'abcdefghij'[n % 10] * 5}" if n < 3 else f"plain words here {'abcdefghij'[n % 10] * 5}", int(n < 3)) for n, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert min(got[k] for k in ids[:3]) > max(got[k] for k in ids[3:])


def test_scorer_adds_the_weights_of_what_it_reads():
    reader = toxicity.Reader({"grim": 0, "grim~": 1}, {"grim": 0, "grim~": 1, "day": 2})
    model = toxicity.Model({"grim": 0, "grim~": 1}, {"grim": 0, "grim~": 1, "day": 2}, np.arange(1, 3 + 2 * len(toxicity.HITS) + 1) * 0.1, -0.5)
    # places: grim, grim~, day, hit words over 1 2 3 5, lexicons over 1 2 3 5
    want = {"": set(), "a grim and grimmest day": {0, 1, 2, 3, 4, 7, 8}, "Grim grim grim grim grim": {0, 3, 4, 5, 6, 7}, "plain words only": set()}
    for t, places in want.items():
        assert reader.read(t)[0] == places
        assert abs(toxicity.Scorer(model).score(t) - 1 / (1 + np.exp(0.5 - sum(0.1 * (p + 1) for p in places)))) < 1e-12


def test_label_model_weighs_good_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    good = [np.where(y & (rng.random(4000) < 0.8), 1, 0) for _ in range(4)]
    noise = [np.where(rng.random(4000) < 0.2, 1, 0) for _ in range(2)]
    echo = [noise[0]] * 6  # says again what one bad voter says: correlation, not evidence
    silent = np.where(np.sum(good, axis=0) == 0, -1, 0)
    votes = np.stack([*good, *noise, *echo, silent], axis=1)  # and a label that errs in a tenth gives the first guess
    p = toxicity.label_model(votes, np.where(y ^ (rng.random(4000) < 0.1), 0.8, 0.03), np.ones(4000), 0.2)
    assert ((p > 0.5) == y).mean() > 0.97
    level = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    parent = toxicity.voter_tree(level, p, np.ones(4000))
    assert all(votes[:, parent[k]].tolist() == echo[0].tolist() for k in range(7, 12))


def area_under_curve(scores, y):
    above = [(a > b) + (a == b) / 2 for a, i in zip(scores, y, strict=True) if i for b, j in zip(scores, y, strict=True) if not j]
    return sum(above) / len(above)


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.75), ("sf0.1", 0.98)])
def test_toxicity_on_held_out_rows(spark, sf, least):
    docs, labels = (documents(spark, f"/root/testdata/{sf}", t) for t in ("documents", "labels"))
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    runs = [{r.doc_id: r for r in toxicity.toxicity(docs.repartition(n), labels).collect()} for n in (3, 11)]
    assert {k: r.score for k, r in runs[0].items()} == {k: r.score for k, r in runs[1].items()}
    held = [r for k, r in runs[0].items() if r.held_out and k in marks]
    y = [marks[r.doc_id] for r in held]
    assert area_under_curve([r.score for r in held], y) >= least
    # No word chosen by the training labels alone does as well.
    train = [(set((r.text or "").lower().split()), marks[r.doc_id]) for r in docs.collect() if r.doc_id in marks and not runs[0][r.doc_id].held_out]
    counts = {t: Counter(w for ws, m in train if m == t for w in ws) for t in (0, 1)}
    n = Counter(m for _, m in train)
    odds = {w: math.log((counts[1][w] + 0.5) / (n[1] + 1)) - math.log((counts[0][w] + 0.5) / (n[0] + 1)) for w in counts[1]}
    best = max(odds, key=lambda w: odds[w] * counts[1][w])
    words = {r.doc_id: set((r.text or "").lower().split()) for r in docs.collect()}
    assert area_under_curve([r.score for r in held], y) >= area_under_curve([float(best in words[r.doc_id]) for r in held], y)


def test_pii(odd, empty):
    field = pii.fit(odd)
    t = texts(odd)
    got = {r.doc_id: r for r in pii.span_digests(pii.spans(odd, field)).collect()}
    for k, r in got.items():
        base = ",".join(f"{a}:{b}:{c}" for a, b, c in pii.base_spans(t[k]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert all(s in r.spans.split(",") for s in base.split(",") if s)
    assert pii.base_spans("a@b.co_d@e.f") == [("email", 0, 6), ("email", 6, 12)]
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    assert pii.base_spans("+1 (555) 555-5555") == [("phone", 0, 17)]
    assert pii.base_spans("256.1.1.1 1.1.1.1") == [("ip", 10, 17)]
    assert pii.spans(empty, pii.fit(empty)).count() == 0


def brute_base(text):
    """The contract's patterns, as they are written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [("ip", *m.span())] * all(int(p) <= 255 for p in m.group().split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c in "0123456789"]
        double = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
        out += [("card", *m.span())] * (13 <= len(digits) <= 19 and double % 10 == 0)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [("phone", *m.span())] * (9 <= sum(c in "0123456789" for c in m.group()) <= 15)
    return out


def test_base_spans_are_the_plain_patterns(real):
    rng = random.Random(9)
    parts = ["a@b.co", "@", ".", "1.2.3.4", "255.255.255.256", "4111 1111 1111 1111", "+1 (555) 555-5555", "+49.30", "-", " ", "x", "00", "5", "é", "_%+", "..", "a.b-c@d-e.f.g", "١٢٣"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(t) == brute_base(t), t
    for t in texts(real).values():
        assert pii.base_spans(t) == brute_base(t)


def test_field_is_a_function_of_the_rows(spark, real):
    once = real.select("doc_id", "text")
    odd_ids = once.limit(20).select(F.lit(None).cast("long").alias("doc_id"), "text")
    many = once.unionByName(odd_ids)
    for _ in range(3):
        many = many.unionByName(once.limit(50))  # rows repeated under their ids
    a, b = pii.fit(once.unionByName(odd_ids).repartition(3)), pii.fit(many.repartition(11))
    assert np.array_equal(a.unary, b.unary) and np.array_equal(a.chain, b.chain)


def test_skip_edges_carry_labels():
    rng = random.Random(4)
    train = []
    for _ in range(300):
        s = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        train += pii.training_rows(f'see token = "{s}" then {s} and id {rng.randint(10**5, 10**9)}')
    field = pii.fit_field(*(np.array(c, float if k != 1 else int) for k, c in enumerate(zip(*train, strict=True))))
    secret = "9f" * 20
    text = f'key: "{secret}" filler words here, much later {secret} again'
    assert [s for s in pii.find(text, field) if s[0] == "secret"] == [("secret", m.start(), m.end()) for m in re.finditer(secret, text)]
    assert secret not in pii.redact(text, field)


@pytest.mark.parametrize("between", [" ", " filler words that keep the mentions well apart "])
def test_one_assignment_labels_all_mentions(between):
    rng = random.Random(4)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    train = []
    for k in range(300):
        s = hexes()
        train += pii.training_rows(f"key: '{s}' then {s} and id {rng.randint(10**5, 10**9)}" if k % 3 == 0 else f"see commit {s} then {s} and id {rng.randint(10**5, 10**9)}")
    field = pii.fit_field(*(np.array(c, float if k != 1 else int) for k, c in enumerate(zip(*train, strict=True))))
    token = "9f" * 20
    rest = between.join([token] * 29)
    assert pii.find(rest, field) == []
    for text in (f"key: '{token}'{between}{rest}", f"{rest}{between}key: '{token}'"):
        assert pii.find(text, field) == [("secret", m.start(), m.end()) for m in re.finditer(token, text)]


def test_short_alike_tokens_share_an_edge():
    assert [k for _, _, k in pii.Graph("AB12 and, after words that part them, CD34").edges] == [2]


def test_training_draws_from_all_of_a_long_text():
    text = " ".join(f"n{10000 + k}" for k in range(500)) + " token = '" + "9f" * 20 + "'" + "".join(f" +{10**10 + k} and" for k in range(200))
    rows = pii.drawn_rows(text, 64)
    assert len(rows) == 64 and rows == pii.drawn_rows(text, 64) and any(r[1] for r in rows)
    assert pii.drawn_rows(text, 10_000) == pii.training_rows(text)


def test_tiff(odd, empty):
    rng = random.Random(2)
    for n in (64, 640, 64 * 1024 * 3 + 64):
        for _ in range(12 if n < 1000 else 2):
            b = bytes(rng.choice(b"aaaab\0") for _ in range(n))
            assert tiff.lzw_decode(tiff.lzw_encode(b), n) == tiff.unpack_bits(tiff.pack_bits(b), n) == b
            assert b"".join(p[4] for p in tiff.read_pages(tiff.write_tiff(b))) == b
    t = texts(odd)
    for r in tiff.media_round_trip(odd).collect():
        b = t[r.doc_id].encode()
        p = b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert tiff.media_round_trip(empty).count() == 0
    assert [p[5] for p in tiff.read_pages(b"not an image")] == ["not a TIFF file"]
    assert next(tiff.read_pages(tiff.write_tiff(b"x" * 64)[:40]))[4] is None


def test_broken_tiffs_give_error_rows(spark):
    good = tiff.write_tiff(bytes(range(64)) * 40)
    (at,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, at)
    place = {struct.unpack_from("<H", good, at + 2 + 12 * k)[0]: at + 2 + 12 * k for k in range(n)}
    assert [p[5] for p in tiff.read_pages(good)] == [None]

    def patched(tag, value, count=None):
        b = bytearray(good)
        kind = struct.unpack_from("<H", b, place[tag] + 2)[0]
        struct.pack_into("<H" if kind == 3 else "<I", b, place[tag] + 8, value)
        if count is not None:
            struct.pack_into("<I", b, place[tag] + 4, count)
        return bytes(b)

    broken = [patched(tiff.T_WIDTH, 0), patched(tiff.T_HEIGHT, 0), patched(tiff.T_HEIGHT, 2**31), patched(tiff.T_HEIGHT, 2**32 - 1), patched(tiff.T_SAMPLES, 0), patched(tiff.T_COMPRESSION, 99), patched(tiff.T_PREDICTOR, 7), patched(tiff.T_BITS, 16)]
    for tag in (tiff.T_ROWS_PER_STRIP, tiff.T_TILE_WIDTH, tiff.T_TILE_HEIGHT):
        if tag in place:
            broken += [patched(tag, 0), patched(tag, 2**31)] if tag != tiff.T_ROWS_PER_STRIP else [patched(tag, 0)]
    broken += [patched(tiff.T_BITS, 8, 2**31), good[:at], good[: at + 5], good[:9], b"II*\0\0\0\0\1"]
    for b in broken:
        assert all(p[4] is None and p[5] for p in tiff.read_pages(b)), b[:16]
    rng = random.Random(11)
    for _ in range(300):  # any damage at all
        b = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        list(tiff.read_pages(bytes(b)))
    media = spark.createDataFrame([(k, b) for k, b in enumerate([good, *broken, b"", None])], "doc_id long, media binary")
    rows = tiff.tiff_pages(media).collect()
    assert sum(r.error is None for r in rows) == 1


def test_tiffs_of_other_writers():
    """Big-endian files, several channels and several tiles across, written here."""
    rng = np.random.default_rng(3)
    for order in "<>":
        for channels, wide, high in ((1, 16, 16), (3, 16, 32)):
            image = rng.integers(0, 256, (50, 40, channels)).astype(np.uint8)
            across, down = -(-40 // wide), -(-50 // high)
            padded = np.zeros((down * high, across * wide, channels), np.uint8)
            padded[:50, :40] = image
            body, offsets, counts = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)), [], []
            for y in range(down):
                for x in range(across):
                    tile = padded[y * high : (y + 1) * high, x * wide : (x + 1) * wide].copy()
                    tile[:, 1:] -= tile[:, :-1].copy()
                    packed = zlib.compress(tile.tobytes())
                    offsets.append(len(body))
                    counts.append(len(packed))
                    body += packed
            lists = {}
            for tag, values in ((tiff.T_TILE_OFFSETS, offsets), (tiff.T_TILE_COUNTS, counts)):
                lists[tag] = len(body)
                body += struct.pack(f"{order}{len(values)}I", *values)
            bits = len(body)
            body += struct.pack(f"{order}{channels}H", *[8] * channels)
            struct.pack_into(f"{order}I", body, 4, len(body))
            fields = [(tiff.T_WIDTH, 4, 1, 40), (tiff.T_HEIGHT, 4, 1, 50), (tiff.T_BITS, 3, channels, bits if channels > 2 else None), (tiff.T_COMPRESSION, 3, 1, 8), (tiff.T_SAMPLES, 3, 1, channels), (tiff.T_PREDICTOR, 3, 1, 2), (tiff.T_TILE_WIDTH, 4, 1, wide), (tiff.T_TILE_HEIGHT, 4, 1, high), (tiff.T_TILE_OFFSETS, 4, len(offsets), lists[tiff.T_TILE_OFFSETS]), (tiff.T_TILE_COUNTS, 4, len(counts), lists[tiff.T_TILE_COUNTS])]
            body += struct.pack(f"{order}H", len(fields))
            for tag, kind, count, value in fields:
                value = 8 if value is None else value
                body += struct.pack(f"{order}HHI", tag, kind, count) + (struct.pack(f"{order}HH", value, 0) if kind == 3 and count == 1 else struct.pack(f"{order}I", value))
            body += struct.pack(f"{order}I", 0)
            ((_, w, h, c, samples, error),) = tiff.read_pages(bytes(body))
            assert error is None and (w, h, c) == (40, 50, channels) and samples == image.tobytes()


def test_packing(odd, real, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for df in (odd, real):
        got = sorted(packing.pack(df, path, length=256).collect(), key=lambda r: (r.sequence_id, r.offset))
        at, per = 0, {}
        for r in got:
            assert r.sequence_id * 256 + r.offset == at and 0 < r.length <= 256 - r.offset
            at += r.length
            per.setdefault(r.doc_id, []).append(r)
        for k, v in texts(df).items():
            own = sorted(per[k], key=lambda r: r.start)
            ids = np.asarray([*t.encode(v, add_special_tokens=False).ids, 2], "<u4").tobytes()
            assert b"".join(bytes(r.ids) for r in own) == ids, k
    assert packing.pack(empty, path).count() == 0


def test_word_merges_are_the_librarys():
    rng = random.Random(8)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    parts = "the of and ing ion er re th st in an on at en nd or es it un con dis ness able ment ous ful ity ly a e i o u s t".split()
    some = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(30_000)}
    some |= {"".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüßñ漢字") for _ in range(rng.randint(1, 16))) for _ in range(10_000)}
    some |= {"".join(rng.choice("!?#$%&'()*+-./:;<=>@[]^_`{|}~") for _ in range(rng.randint(1, 6))) for _ in range(5_000)} - {"'"}
    for w in sorted(some):
        if words.split(w) == [w]:
            assert words[w] == words.plain(w), w


def test_hilbert_keys_are_a_walk():
    cube = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(cube, 3)
    assert sorted(keys) == list(range(512))
    walk = cube[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_lattice_scores(odd, real, empty):
    path = P.path("piece_bpe_32k.model")
    for df in (odd, real):
        rows = texts(df)
        words = {k: [w for w in SPACES.split(re.sub("[A-Z]", lambda m: m.group().lower(), t)) if w] + [None] for k, t in rows.items()}
        c = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
        n, v = sum(c.values()), len(c)
        for r in lattice_lm.score_documents(df, path).collect():
            ws = words[r.doc_id]
            base = math.fsum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lattice_lm.score_documents(empty, path).count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = ([("▁", -2.0), ("▁a", -1.5), ("a", -1.0), ("ab", -2.5), ("b", -1.2)], {k: -9.0 for k in range(256)}, -3.0)
    lattice = lattice_lm.Lattice(vocabulary)

    def every(s):
        if not s:
            return 1.0
        total = math.exp(lattice.spell(s[0])) * every(s[1:])
        return total + sum(math.exp(w) * every(s[len(p) :]) for p, w in lattice.pieces.items() if s.startswith(p))

    words = [b"abab", b"b", b"a", lattice_lm.END, b"abcab", b"ab" * 7]
    got = lattice.log_probabilities(words)
    assert all(math.isclose(p, -3.0 if w == lattice_lm.END else math.log(every("▁" + w.decode())), rel_tol=1e-12) for w, p in zip(words, got, strict=True))
    # A piece's expected count is how its weight moves the logarithm of the probability.
    counts = Counter()
    lattice.expect(words, counts)
    for p in ("a", "ab", "▁"):
        moved = lattice_lm.Lattice(([(q, w + 1e-6 * (q == p)) for q, w in vocabulary[0]], *vocabulary[1:]))
        assert math.isclose(counts[p], float((moved.log_probabilities(words) - got).sum()) / 1e-6, rel_tol=1e-4)
    assert counts[lattice_lm.END] == 1
    assert math.isclose(sum(n * len(p) for p, n in counts.items() if isinstance(p, str)) + sum(n for p, n in counts.items() if isinstance(p, int) and p < 128), sum(len(w) + 1 for w in words if w != lattice_lm.END) - counts[0xE2])


def brute_components(rows, width, percent):
    sets = {}
    for k, t in rows.items():
        ws = [w for w in SPACES.split(re.sub("[A-Z]", lambda m: m.group().lower(), t)) if w]
        sets[k] = {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())
    least = {k: k for k in rows}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {k: (len(sets[k]), least[k]) for k in rows}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, odd, empty, width, percent):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(150)]
    for k in range(120):
        words = list(base) if k % 3 else [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 - k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, width=width, percent=percent).collect()}
    assert got == brute_components(texts(df), width, percent)
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_join_of_ids_with_several_texts(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(0, 60, 6):
        one, two = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(2))
        near = lambda ws: " ".join([*ws[:-1], "changed"])
        rows += [(k + 1, " ".join(one)), (k + 1, " ".join(two)), (k + 1, " ".join(two)), (k + 2, near(one)), (k + 3, near(two)), (k, " ".join(two)), (k + 4, "alone %d" % k)]
        want |= {k: k, k + 1: k, k + 2: k, k + 3: k, k + 4: k + 4}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_components(df, width=4, percent=85).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_rows_without_ids(spark, real):
    """A null id is a row like others: no operator drops it or fails."""
    rows = real.select("doc_id", "text").limit(30).unionByName(real.limit(10).select(F.lit(None).cast("long").alias("doc_id"), "text")).withColumn("score", F.lit("clash"))
    labels = documents(spark, SF, "labels")
    n = rows.count()
    assert n == 40
    assert token_counts.token_counts(rows, P.path("byte_bpe_50k.json")).count() == n
    assert sorted(r.slot for r in sharding.byte_shards(rows, 1).collect()) == list(range(n))
    assert bpe.encode_documents(rows, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == n
    assert [r.held_out for r in toxicity.toxicity(rows, labels).collect() if r.doc_id is None] == [False] * 10
    assert quality.quality_verdicts(rows).count() == pii.spans(rows, pii.fit(rows)).count() == tiff.media_round_trip(rows).count() == n
    assert packing.pack(rows, P.path("word_bpe_49k.json")).filter("doc_id is null and start = 0").count() == 10
    assert lattice_lm.score_documents(rows, P.path("piece_bpe_32k.model")).filter("doc_id is null and not held_out").count() == 10
    assert ngram_join.ngram_components(rows).count() == n


def test_signatures_meet_for_every_link():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 7, 12, 40, 150, 800):
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            k = ngram_join.difference(len(x), len(x), 85)
            gone = rng.integers(0, k // 2 + 1)
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, rng.integers(0, k + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                assert set(ngram_join.signatures(x, 85)) & set(ngram_join.signatures(y, 85))


def test_media_takes_one_worker_a_task(spark):
    """Store, read and digest in one pass over Python give what the three operators give one after another."""
    rows = [(1, ""), (2, None), (3, "a" * 70_000 + "ü"), (4, "word " * 30), (5, "word " * 30)] + [(k, f"text {k} " * (k % 50)) for k in range(6, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = tiff.media_round_trip(docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    stored = tiff.store_texts(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tiff.page_digests(tiff.tiff_pages(stored)).collect())) and got.count() == len(rows)


def test_signatures_leave_the_disk_once_buckets_are_stored(spark, monkeypatch):
    import time

    held = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    sizes, release = [], ngram_join.release

    def spy(session):
        before, at = held.size(), time.time()
        release(session)
        while held.size() >= before and time.time() - at < 5:
            time.sleep(0.1)
        sizes.append((before, held.size()))

    monkeypatch.setattr(ngram_join, "release", spy)
    words = [f"w{k}" for k in range(90)]
    docs = spark.createDataFrame([(k, " ".join(words[:60] + [f"x{k % 7}"])) for k in range(40)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.ngram_components(docs).collect()} == {0}
    assert len(sizes) == 3 and sizes[0][1] < sizes[0][0]
