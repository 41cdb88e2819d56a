"""A corpus made ready for training: five stages, each applied to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import decontaminate, mixing, pii, simhash, toxicity
from tremor.llm.carry import some_of, wanted_ids
from tremor.llm.common import bounded_batches, read, settle, shared_path
from tremor.llm.queries import pii_key


#: Columns that the stages add for their own use.
_NAME, _ROW = "__name", "__row"


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labelled ones of its training folds, scores below 0.3.

    Rows are told apart by id and text, so rows that repeat an id are judged each."""
    labels = read(spark, sf_dir, "labels")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label IN (0, 1)")
    known = known.where(toxicity.fold_of("doc_id", 4) != 2)
    toxicity.bounded_batches(spark)
    model = toxicity.fit(toxicity.labelled_texts(docs.select("doc_id", "text"), known))
    return toxicity.apply(docs.select(F.struct("*").alias("kept"), "text"), model).where("score < 0.3").select("kept.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, texts that share 0.8 or more of their five-word shingles.

    The one of the least id stays; rows without an id stand behind all others, and of rows with equal id and text
    the least by all columns stays. Rows with equal ids and different texts are different documents. Texts without
    a word, empty and null ones included, are duplicates of equal ones only."""
    named = docs.withColumns({_NAME: F.xxhash64("text"), _ROW: F.xxhash64("doc_id", "text")})
    classes = simhash.similar(docs.select("text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", _ROW)
    firsts = named.select(_NAME, "doc_id", _ROW).join(classes, F.col(_NAME) == F.col("name"), "left").withColumn("class", F.coalesce("class", _NAME))
    firsts = settle(firsts.groupBy("class").agg(F.min(order).alias("one"), F.count("*").alias("n")).select("class", F.col(f"one.{_ROW}").alias(_ROW), "n"))
    # Rows that are alone in their class stay where they are; texts of all others, and of some that a full filter takes for such, are shuffled.
    many = settle(firsts.where("n > 1").select("class"))
    some = named.select(_NAME, _ROW).join(classes, F.col(_NAME) == F.col("name"), "left").select(F.coalesce("class", _NAME).alias("class"), _ROW).join(many, "class", "left_semi")
    shared = wanted_ids(docs, some.select(F.col(_ROW).alias("doc_id")))
    rows = named.select(F.col(_ROW).alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("one"))
    schema = rows.schema
    bounded_batches(spark)
    alone = rows.mapInArrow(lambda batches: some_of(batches, shared, False), schema).select("one.*")
    rest = rows.mapInArrow(lambda batches: some_of(batches, shared), schema)
    kept = rest.join(firsts.select(F.col(_ROW).alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("one").alias("one"))
    return alone.union(kept.select("one.*"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item is half covered by tiles of five words or more; rows without an id are judged by their text as any other."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets in their texts replaced; null texts stay null."""
    return pii.pseudonymise(docs, pii_key(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of their copies; columns of docs named like its results give way to them."""
    return mixing.mix(docs).where("copies > 0").drop("source_size", "target")


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]

#: The stages learn a model and link fingerprints, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
