"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runtime import table
from . import canon, chunk, match, pack, pii, survivor, tokens, topn

CAPACITY = 2048


def _good(score: str):
    return F.col(score).isNotNull() & ~F.isnan(score)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "disease_associations").filter(_good("score")).select(F.lit("disease_associations").alias("src"), F.col("disease_id").alias("group_key"), F.col("assoc_id").alias("item_id"), "score", F.col("evidence_count").alias("evidence"))
    h = table(spark, d, "hypotheses").filter(_good("score")).select(F.lit("hypotheses").alias("src"), F.col("source_id").alias("group_key"), F.col("hypothesis_id").alias("item_id"), "score", F.lit(0).alias("evidence"))
    n = F.when(F.col("src") == "hypotheses", 3).otherwise(5)
    code = [topn.score_code(F.col("score")), topn.descending(F.col("evidence")), topn.ascending(F.col("item_id"))]
    return topn.top_n(a.unionByName(h), group=["src", "group_key"], code=code, item="item_id", n=n)


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """All candidate pairs with their confidence."""
    drugs = match.match_drugs(table(spark, d, "chembl_drugs"), table(spark, d, "drug_associations"))
    genes = match.match_genes(table(spark, d, "gene_info"), table(spark, d, "uniprot_proteins"))
    return drugs.unionByName(genes).select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), F.round("confidence", 4).alias("confidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).filter("confidence >= 0.5").select("key_a", "key_b")


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pubmed_articles").select(F.lit("pubmed_articles").alias("src"), F.col("article_id").alias("item_id"), F.col("abstract").alias("text"))
    t = table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("item_id"), "text")
    return p.unionByName(t)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = chunk.split_texts(_long_texts(spark, d), keys=["src", "item_id"], text="text")
    return pieces.filter("piece = 1").select("src", "item_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunk.split_texts(_long_texts(spark, d), keys=["src", "item_id"], text="text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "clinical_intake").createOrReplaceTempView("p4_intake")
    rows = spark.sql(r"""
        SELECT DISTINCT * FROM (
          SELECT request_id, 'drugs' AS field, pos, value, 'drug' AS kind FROM p4_intake LATERAL VIEW posexplode(drugs) x AS pos, value
          UNION ALL SELECT request_id, 'input_term', 0, input_term, 'phenotype' FROM p4_intake
          UNION ALL SELECT request_id, 'condition', 0, `condition`, 'disease' FROM p4_intake)
        WHERE value IS NOT NULL AND NOT value RLIKE '^(?U)\\s*$'""")
    mapped = canon.map_terms(spark, rows, table(spark, d, "vocab_terms"))
    return canon.resolve(spark, rows, mapped).select("request_id", "field", "pos", "term_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    best = survivor.best_fields(table(spark, d, "kg_nodes"), table(spark, d, "source_trust"))
    return best.select("id", "field", F.col("record").alias("record_id"))


def p6_undated(spark: SparkSession, d: str) -> DataFrame:
    """The best records where every third record has lost its time, so that the learned order of values decides."""
    nodes = table(spark, d, "kg_nodes").withColumn("updated_at", F.when(F.col("record_id") % 3 != 0, F.col("updated_at")))
    return survivor.best_fields(nodes, table(spark, d, "source_trust")).select("id", "field", F.col("record").alias("record_id"), "value")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    s = survivor.survivors(table(spark, d, "kg_nodes"), table(spark, d, "source_trust"))
    props = F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return s.select("id", "name", F.coalesce(props, F.lit("")).alias("properties"), F.coalesce(F.array_join("sources", "|"), F.lit("")).alias("sources"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), key="doc_id", text="text")


def p9_bins(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, d, "documents"), key="doc_id", text="text")
    return pack.pack(sizes, key="doc_id", size="tokens", capacity=CAPACITY)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents"), key="doc_id", text="text")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), key="doc_id", text="text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
