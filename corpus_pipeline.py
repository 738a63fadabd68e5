"""Corpus pipeline: toxicity, near-duplicates, repeated passages, mixing and packing, each over all that the last one kept.

Every stage takes and keeps rows, not ids: rows with a null doc_id, and rows that repeat one, are documents of their own.
Null texts count as empty ones, other columns than those of documents are left behind, and an empty table gives an empty
result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import mixing, packing, similar_texts, suffix_dedup, toxicity
from corvina.llm.common import staged
from corvina.llm.queries import bounded_batches, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The near-duplicate stage links texts whose sets of shingles of so many words have this Jaccard similarity or more.
SHINGLE, SIMILARITY = 5, 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees find toxic (score 0.7 or more) go.

    A null or empty text has the score of a text without words; copies are judged alike; all other rows stay as they are.
    """
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs.select(*COLUMNS), toxicity.train(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest doc_id, of several with it the first.

    SimHash tries propose the pairs, prefixes of the sets give those that they miss, and the exact similarity of their shingles
    decides: no link is missing, and a text without a near copy always stays. Null and blank texts are one group (the empty set), so one of them stays; rows with a null doc_id stay only where no
    row of their group has one.
    """
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # two long sets a row, where pairs are verified
    found = similar_texts.similar(docs, shingle=SHINGLE, similarity=SIMILARITY, carry=COLUMNS)
    return found.filter("first").select("row.*")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut; documents of which no word is left go.

    Rows with a null doc_id come after all others, rows that repeat one after one another; null and blank texts have no
    word and go.
    """
    bounded_batches(spark)
    cut = suffix_dedup.remove_repeats(docs, with_kept=True, carry=["lang", "source"])
    return cut.filter(F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]")).select(
        "doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.length("kept_text").cast("long").alias("n_chars")
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their raked weights say, some more than once: 90 % of the tokens in expectation.

    Rows of one doc_id draw alike; a row without one draws by its text; null texts have no tokens and their cell's weight.
    """
    bounded_batches(spark)
    taken = mixing.mix(docs, carry=COLUMNS).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of 2048 tokens; every row is packed, also one that is there more than once."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained trees, induced sorting and a tokenizer have no SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
