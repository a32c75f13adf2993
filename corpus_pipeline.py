"""A corpus pipeline: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the shared scratch folder and reads it
again for the next. Packing can't be expressed in SQL, so there is no oracle; the operators behind the stages are
tested against brute force each.

Nulls and odd rows: a null or empty text is clean, has no near copy and no window, is never repeated by the mix (so it leaves
there), and rows that repeat a doc_id with its text are one document after the second stage. Ties go to the smallest doc_id. Texts are
whole at any length. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm.jaccard_join import jaccard_components
from streamledger.llm.mixing import cycle_weights, mix
from streamledger.llm.packing import pack
from streamledger.llm.runtime import materialize
from streamledger.llm.substring_dedup import remove_repeated_windows
from streamledger.llm.toxicity import learn, score, training_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the lexicon is learned from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    lexicon = learn(docs, training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, lexicon, *COLUMNS).where("_predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of 0.8-similar texts, once; a row without doc_id stays."""
    found = jaccard_components(docs, 5, 80).where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(found, docs.doc_id.eqNullSafe(found.kept_id), "left_semi").select(*COLUMNS)
    return kept.dropDuplicates(["doc_id", "text"])


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows that an earlier document has. A text that keeps all its words stays as it is; one that keeps none goes."""
    cut = remove_repeated_windows(docs, 13, F.struct("lang", "source", "n_chars")).where("n_removed = 0 OR n_removed < n_words")
    whole = F.col("n_removed") == 0
    n_chars = F.when(whole, F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    text = F.when(whole, F.col("text")).otherwise(F.col("kept_text"))
    return cut.select("doc_id", text.alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time."""
    mixed, _ = mix(docs, F.array("source"), weigh=cycle_weights, max_repeats=2, keep=COLUMNS)
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
