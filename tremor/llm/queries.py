"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontaminate, fingerprint_index, jaccard_join, mixing, oracles, perplexity, pii, prefix_trie, repeats, rules, simhash, source_audit, toxicity
from .common import read


#: A public key, for the registered query and the pipeline on made-up texts where spark.tremor.pii.key is not set.
DEMO_KEY = "public key of the registered query"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.tremor.pii.key", DEMO_KEY)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.filter_quality(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), least=5, coverage=0.5)
    return found.withColumn("contaminated", F.lit(True))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic", folds=4, held=2, threshold=0.3)


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken")


def op7_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.deduplicate(read(spark, sf_dir, "documents"), span=13, batches=2)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", folds=4, held=2, threshold=0.7)


def op9_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicate(read(spark, sf_dir, "documents"), span=200)


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(read(spark, sf_dir, "documents"), folds=5, held=1)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(read(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_classes(read(spark, sf_dir, "documents"), percent=85, words=4)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(*prefix_trie.placed(read(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_perplexity": op3_perplexity,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_pareto_mixing": op6_pareto_mixing,
    "op7_fingerprint_index": op7_fingerprint_index,
    "op8_rules": op8_rules,
    "op9_maximal_repeats": op9_maximal_repeats,
    "op10_context_tree": op10_context_tree,
    "op11_source_audit": op11_source_audit,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op6_pareto_mixing": oracles.OP6,
    "op7_fingerprint_index": oracles.OP7,
    "op9_maximal_repeats": oracles.OP9,
    "op11_source_audit": oracles.OP11,
    "op12_jaccard_join": oracles.OP12,
    "op13_prefix_trie": oracles.OP13,
}
