"""A corpus in five stages: language ID, near-dedup, substring dedup, source mix, packing.

Each stage works on all rows that its predecessor kept, reads the rows from that stage's Parquet table, and all but
the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm import language, mixing, packing, phrases, setsketch
from zonecast.llm.store import aside, saved

# Short clean texts score 0.3 and more, texts that share no n-gram statistics with any language about 0.
LEAST_SCORE = 0.15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language of the labelled rows; texts without letters and without a likeness to any go.

    ``lang`` is from here on the language found in the text, which the source mix goes by, also where a label was missing.
    """
    model = language.fit(docs.select("text", "lang"))
    return language.in_known_language(docs, model, LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the smallest id; rows without an id stay.

    Rows that share an id are rows of their own: near copies leave one, and a text unlike the others stays. Their keys rise
    with the id and are made once in a written table. Other columns stay, whatever their names.
    """
    docs, back = aside(docs, ("_row",))
    line = ("doc_id", F.xxhash64("text"))
    key = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    keyed = saved(docs.repartitionByRange(*line).sortWithinPartitions(*line).withColumn("_row", key), "near-rows")
    near = setsketch.near_documents(keyed.select(F.col("_row").alias("doc_id"), "text"))
    gone = near.where("NOT kept").select(F.col("doc_id").alias("_row"))
    return keyed.join(gone, "_row", "left_anti").select(docs.columns).withColumnsRenamed(back)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words and more that an earlier document holds."""
    kept = phrases.drop_repeats(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*[changed.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights within each identified language; a document taken twice is two rows.

    A language keeps its share of all words, whatever sources hold it.
    """
    return mixing.mixed(docs, within=("lang",))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    pieces = packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
