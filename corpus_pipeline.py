"""From raw documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import language, line_dedup, mixing, packing, simhash
from cohortloom.llm.queries import tokenizer_path
from cohortloom.plans.lineage import cut

#: A document is rejected if the best mean posterior is below this times that of a blind guess.
LEAST_TIMES_CHANCE = 1.2
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Rejected: texts that are null or have no letter, and those whose words lean to no language.
    The label ``lang`` is kept as it is; it is learned from, not judged.
    """
    model = language.learn(docs, language.allowed_to_learn("doc_id"))
    found = language.detect(docs.select(*DOCUMENT), model)
    sure = F.col("score") >= LEAST_TIMES_CHANCE / max(len(model.labels), 2)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & sure).select(*DOCUMENT)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document has; ``n_chars`` follows the text."""
    marked = line_dedup.dedup_lines(docs.select(*DOCUMENT))
    kept = marked.withColumn("text", line_dedup.kept_text("text", F.col("drop_bits")))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


#: Columns that tell all rows apart: content first, so that which of several rows is meant does not hang on files.
ROW = ["_content", "_also", "_file", "_row"]


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with two hashes of their content and their place in the stored table, which survives a second read."""
    try:
        placed = docs.select(*DOCUMENT, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # no stored table
        return numbered(cut(docs.select(*DOCUMENT)))
    return placed.withColumns({"_content": F.xxhash64(*DOCUMENT), "_also": F.xxhash64(F.lit(1), *DOCUMENT)})


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, by the rule of ``op3_simhash``: the one with the smallest id.

    Null ids come last; rows of one id go by their content, and rows that are equal in all columns are one group.
    """
    rows = numbered(docs)
    ranks = {"_null": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))}
    stays = cut(simhash.first_of_each(rows.withColumns(ranks), ["_null", "_id", *ROW]))
    return rows.join(stays.select("_file", "_row"), ["_file", "_row"], "left_semi").select(*DOCUMENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; of rows with equal content any may get the odd copy."""
    rows = numbered(docs).withColumn("_key", F.struct("_content", "_also"))
    copies = mixing.mix(rows, key="_key", carry=["_file", "_row"]).where("copies > 0").select("_file", "_row", "copies")
    taken = rows.join(copies, ["_file", "_row"])
    return taken.select(*DOCUMENT, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*DOCUMENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences."""
    return packing.pack(docs, packing.read_tokenizer(tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language", known_language),
    ("line dedup", shared_lines),
    ("near duplicates", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages are a trained model, hashes of words and a tokenizer: SQL has no form of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
