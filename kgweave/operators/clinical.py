"""Rule-based clinical reasoning over tables: interactions, phenotypes, diagnoses, labels, mentions and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .containment import contains_pairs
from .graph import KnowledgeGraph
from .runtime import checkpoint, salted_join


def normalise_names(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(name, id, label): names looked up without regard to case and outer blanks, by name first, then by synonym.

    A name that isn't found keeps an empty id and itself in title case as label."""
    key = F.lower(X.strip(F.col("name")))
    listed = vocabulary.select("id", "label", F.lit(0).alias("how"), F.lower(X.strip(F.col("label"))).alias("key"))
    also = vocabulary.select("id", "label", F.lit(1).alias("how"), F.explode("synonyms").alias("s")).select("id", "label", "how", F.lower(X.strip(F.col("s"))).alias("key"))
    best = listed.unionByName(also).groupBy("key").agg(F.min(F.struct("how", "id", "label")).alias("b"))
    return names.select("name").distinct().withColumn("key", key).join(best, "key", "left").select("name", F.coalesce("b.id", F.lit("")).alias("id"), F.coalesce("b.label", F.initcap("name")).alias("label"))


def interactions(records: DataFrame, wanted: DataFrame | None = None, reactions: DataFrame | None = None) -> DataFrame:
    """Drug interactions: (drug_a, drug_b, severity, escalated, advice), each unordered pair once, the first record by seq.

    ``records``: (seq, drug_a, drug_b, severity); ``wanted`` (drug) keeps pairs with both drugs in it; ``reactions``
    (drug, reaction) raises the severity of pairs that share one by a level."""
    r = records.filter("drug_a is not null and drug_b is not null and drug_a <> drug_b and trim(drug_a) <> '' and trim(drug_b) <> ''")
    if wanted is not None:
        for c in ("drug_a", "drug_b"):
            r = r.join(wanted.select(F.col("drug").alias(c)).distinct(), c, "left_semi")
    pairs = r.groupBy(F.least("drug_a", "drug_b").alias("drug_a"), F.greatest("drug_a", "drug_b").alias("drug_b")).agg(F.min_by("severity", "seq").alias("severity"))
    pairs = pairs.withColumn("severity", X.coerce_severity(F.coalesce("severity", F.lit(""))))
    if reactions is None:
        pairs = pairs.withColumn("escalated", F.lit(False))
    else:
        sets = reactions.select("drug", F.lower("reaction").alias("reaction")).distinct()
        j = pairs.join(sets.withColumnRenamed("drug", "drug_a"), "drug_a").join(sets.withColumnRenamed("drug", "drug_b"), ["drug_b", "reaction"])
        pairs = pairs.join(j.select("drug_a", "drug_b").distinct().withColumn("escalated", F.lit(True)), ["drug_a", "drug_b"], "left").withColumn("escalated", F.coalesce("escalated", F.lit(False)))
    severity = F.when(F.col("escalated"), X.escalate(F.col("severity"))).otherwise(F.col("severity"))
    return pairs.select("drug_a", "drug_b", severity.alias("severity"), "escalated", X.advice(severity).alias("advice"))


def contraindications(labels: DataFrame, conditions: DataFrame) -> DataFrame:
    """(label, condition): labels (label, text) whose text holds the condition, any case."""
    c = conditions.select("condition", F.lower("condition").alias("needle")).distinct()
    t = labels.select(F.col("label").alias("key"), F.lower("text").alias("text"))
    return contains_pairs(t, c.select("needle")).join(c, "needle").select(F.col("key").alias("label"), "condition").distinct()


def search_terms(queries: DataFrame, terms: DataFrame, *, top: int = 10) -> DataFrame:
    """Vocabulary search: (query, rank, term_id, score).

    2 for an equal name, 1 for a name that holds the query, 1 for a synonym that holds the query or stands in it."""
    t = terms.select("term_id", F.lower("name").alias("n"), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.lower(s)).alias("s"))
    q = queries.select("query", F.lower(X.strip(F.col("query"))).alias("q")).distinct().filter("q <> ''")
    names, syn = t.select("term_id", F.col("n").alias("x")), t.select("term_id", F.explode("s").alias("x")).distinct()
    asked = q.select(F.col("q").alias("needle"))
    in_name = contains_pairs(names.select(F.col("term_id").alias("key"), F.col("x").alias("text")), asked).withColumnRenamed("key", "term_id").join(names, "term_id").select(F.col("needle").alias("q"), "term_id", F.when(F.col("needle") == F.col("x"), 3.0).otherwise(1.0).alias("a"), F.lit(0.0).alias("b"))
    held = contains_pairs(syn.select("x").distinct().select(F.col("x").alias("key"), F.col("x").alias("text")), asked).select(F.col("needle").alias("q"), F.col("key").alias("x"))
    holds = contains_pairs(q.select("q").distinct().select(F.col("q").alias("key"), F.col("q").alias("text")), syn.select(F.col("x").alias("needle"))).select(F.col("key").alias("q"), F.col("needle").alias("x"))
    in_syn = held.unionByName(holds).distinct().join(syn, "x").select("q", "term_id", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    hits = in_name.unionByName(in_syn).groupBy("q", "term_id").agg((F.max("a") + F.max("b")).alias("score")).join(q, "q")
    order = W.partitionBy("query").orderBy(F.desc("score"), "term_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query", "rank", "term_id", "score")


def rank_diseases(matches: DataFrame, associations: DataFrame, *, top: int = 10) -> DataFrame:
    """(case, rank, disease, score): sum over a case's phenotypes of match score times association score.

    ``matches``: (case, phenotype, score); ``associations``: (phenotype, disease, score)."""
    a = associations.select("phenotype", "disease", F.col("score").alias("s2"))
    s = matches.join(a, "phenotype").groupBy("case", "disease").agg(F.sum(F.col("score") * F.col("s2")).alias("score"))
    order = W.partitionBy("case").orderBy(F.round("score", 9).desc(), "disease")
    return s.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("case", "rank", "disease", "score")


def differential(kg: KnowledgeGraph, matches: DataFrame, *, top: int = 10) -> DataFrame:
    """(case, rank, disease, score): 0.55 match + 0.25 matched phenotypes of 5 + 0.20 publications of 5, over the 2 * top best matches."""
    assoc = kg.of_type("disease_has_phenotype").select(F.col("target_id").alias("phenotype"), F.col("source_id").alias("disease"), "score")
    best = rank_diseases(matches, assoc, top=2 * top)
    support = matches.select("case", "phenotype").distinct().join(assoc.select("phenotype", "disease").distinct(), "phenotype").groupBy("case", "disease").agg(F.count(F.lit(1)).alias("kg"))
    papers = literature_support(kg)
    j = best.drop("rank").join(support, ["case", "disease"], "left").join(papers, "disease", "left")
    five = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(5)) / 5
    j = j.select("case", "disease", (0.55 * F.col("score") + 0.25 * five("kg") + 0.20 * five("papers")).alias("score"))
    order = W.partitionBy("case").orderBy(F.round("score", 9).desc(), "disease")
    return j.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("case", "rank", "disease", "score")


def literature_support(kg: KnowledgeGraph) -> DataFrame:
    """(disease, papers): publications that mention each disease."""
    return kg.of_type("publication_mentions_disease").groupBy(F.col("target_id").alias("disease")).agg(F.count(F.lit(1)).alias("papers"))


def top_values(rows: DataFrame, group: str, value: str, *, top: int = 5) -> DataFrame:
    """Commonest values of each group: (group, rank, value, n), ties by value."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(group).orderBy(F.desc("n"), value)
    return n.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(group, "rank", value, "n")


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all entries of two arrays taken as sets; 0 if either is empty or null."""
    n = F.size(F.array_union(a, b))
    return F.when((F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0), F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def mentions(texts: DataFrame, names: DataFrame, *, limit: int = 5) -> DataFrame:
    """Names that stand in a text as whole words, case and white space aside: (doc, rank, id, at).

    ``texts``: (doc, text); ``names``: (id, name, kind).  Every run of words of a text that is as long as some name is
    joined to the names by equality, so neither side is compared with all of the other.  Order: first place in the text,
    publications last, longer names first, id; each id once."""
    words = r"[\p{L}\p{N}_]+"
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(words), F.lit(0))
    n = names.filter("name is not null").select("id", "kind", F.length("name").alias("len"), split(F.col("name")).alias("w")).filter(F.size("w") > 0)
    n = checkpoint(n.select("id", "kind", "len", F.array_join("w", " ").alias("key"), F.size("w").alias("size")))
    sizes = sorted(r[0] for r in n.select("size").distinct().collect())  # as many as names have different numbers of words

    def runs_of(k: int) -> Column:
        """Every run of ``k`` words with its place."""
        w = F.col("w")
        run = lambda i: F.struct((i - 1).alias("at"), F.lit(k).alias("size"), F.array_join(F.slice(w, i, F.lit(k)), " ").alias("key"))
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), run)).otherwise(F.array().cast("array<struct<at:int,size:int,key:string>>"))

    each = [runs_of(k) for k in sizes]
    if not each:
        return texts.select("doc", F.lit(0).alias("rank"), F.lit("").alias("id"), F.lit(0).alias("at")).limit(0)
    runs = texts.select("doc", split(F.col("text")).alias("w")).select("doc", F.explode(F.flatten(F.array(*each))).alias("r")).select("doc", "r.*")
    hits = salted_join(runs.groupBy("doc", "key", "size").agg(F.min("at").alias("at")), n, ["key", "size"], F.col("doc"))
    one = hits.groupBy("doc", "id", "kind", "len").agg(F.min("at").alias("at"))
    order = W.partitionBy("doc").orderBy("at", F.when(F.col("kind") == "Publication", 1).otherwise(0), F.desc("len"), "id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("doc", "rank", "id", "at")
