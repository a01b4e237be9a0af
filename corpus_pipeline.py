"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept. All but the last return the columns of
documents; a stage's result is written as Parquet and read again as the next one's input.
A verdict is of a row, not of its id: rows without an id or with one that others have are
judged alone. Null texts have no words and go at the quality rules, as do empty ones; very
long texts are judged, redacted and packed whole; a text just at a threshold of toxicity goes,
one just at the bound of a rule stays, and of near copies that tie (equal rows without ids)
one stays; an empty table goes through as one; extra columns are left behind at the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewind.llm import pii
from rewind.llm.common import arrow_map, checkpoint_folder, documents, durable
from rewind.llm.ngram_join import ngram_components
from rewind.llm.packing import pack, piece_digests
from rewind.llm.quality import ledger, verdicts
from rewind.llm.toxicity import Scorer, fit

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows of this toxicity score or more go, as in toxicity.score.
THRESHOLD = 0.3


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold."""
    shared = spark.sparkContext.broadcast(fit(docs, documents(spark, sf_dir, "labels")))  # as large as in toxicity.score

    def clean(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < THRESHOLD for t in batch.column(1).to_pylist()], pa.bool_()))

    return arrow_map(_typed(docs), clean, SCHEMA)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules of policy v1 keep."""
    rows = F.struct(*[F.col(c) for c in COLUMNS])
    book = ledger(docs.select(rows.alias("row"), "text"), id_col="row").select(F.col("doc_id").alias("row"), "fail_bits", F.monotonically_increasing_id().alias("at"))
    # A filter would be pushed below the measurements and have each of them worked out once per
    # mention; one that reads a number given out row by row too stays above, and nothing is stored.
    return verdicts(book, policy="v1").filter("kept AND at >= 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each class of five-word shingle similarity 0.8 or more.

    Where ids repeat or are null, rows are numbered in the order of their ids, null ones
    last, and classes are of rows.
    """
    rows, key = docs.select(*COLUMNS), "doc_id"
    if not rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        key = "row"
        rows = durable(rows.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64(*COLUMNS)).withColumn(key, F.monotonically_increasing_id()))
    kept = ngram_components(rows, width=5, percent=80, id_col=key).filter("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(*COLUMNS)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    shared = spark.sparkContext.broadcast(pii.fit(docs))  # a few hundred numbers

    def redacted(batches):
        for batch in batches:
            texts = [t if t is None else pii.redact(t, shared.value) for t in batch.column(1).to_pylist()]
            sizes = [n if t is None else len(t) for t, n in zip(texts, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(sizes, pa.int64())], list(COLUMNS))

    return arrow_map(_typed(docs), redacted, SCHEMA)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the curve."""
    return piece_digests(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram jaccard join", drop_near_copies),
    ("pii", redact_private),
    ("packing", pack_sequences),
]

#: Toxicity, PII and packing learn models or tokenise, which SQL can't express.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is stored in the shared checkpoint folder.

    A stage's input goes once its result is stored, so two results at most take up disk; the last one's input stays for the result's reader.
    """
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
    return docs
