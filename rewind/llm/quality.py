"""Quality rules as a bitmask ledger.

Every document is measured once and every rule is evaluated once; the ledger keeps the
measurements and one bit per failed rule. A policy is a version with a mask of binding
rules, so a verdict is `fail_bits & mask = 0` and changing a policy never touches a text.
Ablations (what a rule costs, alone and on top of the others) are sums over the ledger's
distinct bit patterns.

DataFrame functions only, one pass, no shuffle. Windows of three words are compared by
64-bit hashes within one document. A null or empty text has no words and fails the base
rules; a very long text is one row of work, n log n in its words; a rule is failed past its
bound, not on it; repeated rows each give a row; an empty table gives an empty ledger; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

#: Rule name -> failing condition over the measurements (SQL). The position is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "2 * n_symbols > n_words",
    "list_like": "5 * n_bars > n_words",
    "shouting": "2 * n_upper > word_chars",
    "exclaiming": "2 * n_exclaim > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
}

#: Versioned policies: the rules that bind.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_heavy", "list_like", "shouting", "exclaiming", "duplicate_lines", "long_words", "short_words"),
}

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bars", "n_upper", "n_exclaim")


def rule_mask(policy: str, rules: dict[str, str] | None = None) -> int:
    names = list(rules or RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; windows: hashes in order."""

    def covered(s):
        hash_at = lambda k: F.get(s, k)["h"]
        twice = F.filter(s, lambda x, k: (x["h"] == hash_at(k + 1)) | (x["h"] == hash_at(k - 1)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, covered))


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the MEASUREMENTS (long) of every text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    words = base.withColumn("words", F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != ""))
    n = F.size("words")
    at = lambda i: F.get(F.col("words"), i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    hashed = words.withColumn("windows", windows).withColumn("lines", F.filter(F.split("text", "\n"), lambda s: s.rlike(f"[^{SPACE}]")))
    return hashed.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count_of(F.col("text"), "|").alias("n_bars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        _count_of(F.col("text"), "!").alias("n_exclaim"),
    )


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """Measurements and fail_bits of every document: bit k is set where rule k fails."""
    bits = " | ".join(f"(CASE WHEN {condition} THEN {1 << k}L ELSE 0L END)" for k, condition in enumerate((rules or RULES).values()))
    return measure(docs, id_col=id_col, text_col=text_col).withColumn("fail_bits", F.expr(bits))


def verdicts(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept by a policy version."""
    return book.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(rule_mask("base")) != 0, "kept": F.col("fail_bits").bitwiseAND(rule_mask(policy) | rule_mask("base")) == 0})


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents failing it, and failing nothing else (kept if it were dropped).

    Works on the distinct bit patterns with their counts, at most 2 ** rules rows.
    """
    names, mask = list(RULES), rule_mask(policy)
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("n", "fail_bits", F.explode(rules).alias("r"))
    hit = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(mask) == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"), F.lit(policy).alias("policy"))


def quality_verdicts(docs: DataFrame, policy: str = "v1", **columns) -> DataFrame:
    """The ledger with verdicts, in the order a reader wants them."""
    return verdicts(ledger(docs, **columns), policy).select("doc_id", *MEASUREMENTS, "fail_bits", "base_failed", "kept")
