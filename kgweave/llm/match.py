"""Matching entities across sources without keys (problem 2).

Evidence on a pair (equal or nearly equal names, codes, symbols, agreeing attributes) adds up
to log-odds.  Loopy belief propagation over the candidate pairs then weighs how many partners a
record has: pairs and the factors of both sides exchange messages through joins until they
change no more, and each pair's marginal is its confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.runtime import checkpoint, salted_join

# Fixed values.
_ACCENTS = ("áàâäãåāéèêëēíìîïīóòôöõøōúùûüūýÿñçš", "aaaaaaaeeeeeiiiiiooooooouuuuuyyncs")
SALTS = "sodium|potassium|calcium|hydrochloride|hcl|hydrobromide|maleate|besylate|tosylate|mesylate|citrate|phosphate|fumarate|tartrate|succinate|acetate|sulfate|sulphate"
FORMS = r"\d+([.,]\d+)? ?(mg/ml|mg|mcg|ug|g|ml|iu)|film coated|tablets?|tabs?|capsules?|oral|solution|injection|inj|suspension|xr"
STEMS = "sartal|vastal|gliptal|zolam|tide|rsen|cept|stim|mab|nib"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
ROMANS = {"vii": 7, "vi": 6, "iv": 4, "v": 5, "iii": 3, "ii": 2, "i": 1}
# Log-odds of the evidence; PRIOR holds for any candidate pair.
PRIOR, SAME, ALIAS, NEAR, AGREE, DISAGREE, STEM = -2.0, 5.0, 4.0, 3.0, 2.0, -2.5, -4.0
NEAR_SHORT = 1.0
#: Weight of each further partner of a molecule or gene, which may have several, and of a product or protein, which has one.
FURTHER_A, FURTHER_B = 0.5, 0.0
#: Keys of at least LONG characters may differ by two slips, shorter ones, of at least SHORT, by one; from SEGMENTED on they are cut.
SHORT, LONG, SEGMENTED = 4, 9, 22


def plain(text: Column) -> Column:
    """Lower case, no accents, blanks as one."""
    x = F.regexp_replace(F.translate(F.lower(text), *_ACCENTS), r"\p{M}|[®™]", "")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def substance(name: Column) -> Column:
    """The active molecule's name in a product name, letters and digits only; null if nothing is left."""
    x = F.regexp_replace(plain(name), r"\[[^\]]*\]|\((as )?(" + SALTS + r")\)", " ")
    x = F.regexp_replace(x, r"^[^/()]+ / (.+)$", "$1")
    x = F.regexp_replace(x, r"^\S+ \(([^()]+)\) *$", "$1")
    x = F.regexp_replace(x, rf"\b({FORMS}|{SALTS})\b", " ")
    x = F.regexp_replace(x, "[^a-z0-9]", "")
    return F.when(F.length(x) >= 4, x)


def mechanism_key(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(plain(text), r"\([^)]*\)|\bof\b", " "), "[^a-z0-9]+", " ")), " ")
    x = F.array_join(F.array_sort(words), " ")
    return F.when(F.length(x) > 0, x)


def symbol_key(text: Column) -> Column:
    x = F.regexp_replace(F.upper(F.trim(text)), "_HUMAN$", "")
    x = F.regexp_replace(x, f"(?i)^0?(\\d+)-({MONTHS})$", "$2$1")
    x = F.regexp_replace(x, "[^A-Z0-9]", "")
    return F.when(F.length(x) > 0, x)


def gene_name_key(text: Column) -> Column:
    """Name without hedges, catalogue numbers and punctuation, roman numerals at its end as digits."""
    x = F.regexp_replace(plain(text), r"\(.*?\)|^(probable|putative) |[.;,]", "")
    x = F.trim(F.regexp_replace(x, "-", " "))
    for roman, digit in ROMANS.items():
        x = F.regexp_replace(x, f" {roman}$", f" {digit}")
    x = F.regexp_replace(x, "[^a-z0-9]", "")
    return F.when(F.length(x) > 0, x)


def shortened(key: Column) -> Column:
    """The string itself and all strings got by taking one character out.

    Two strings that differ by one slip, an insertion, deletion, substitution or exchange of neighbours, share one of them."""
    n = F.length(key)
    one = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)))
    return F.array_distinct(F.concat(F.array(key), one))


def _twice(key: Column) -> Column:
    """All strings got by taking up to two characters out."""
    return F.array_distinct(F.flatten(F.transform(shortened(key), shortened)))


def _met_by_segments(left: DataFrame, right: DataFrame) -> DataFrame:
    """(ka, kb) of long keys that share a segment at nearly the same place.

    A left key is cut into segments of three characters.  Each slip spoils one of them at most, an exchange across a cut two, so the
    cuts are made at three places, one of which no exchange crosses.  Of the segments of each cutting any three hold an unspoilt one:
    those that fewest right keys have are looked up among all runs of three characters of the right keys."""
    runs = lambda key, start, step: F.transform(F.sequence(start, F.length(key) - 2, F.lit(step)), lambda i: F.struct(i.alias("at"), F.substring(key, i, F.lit(3)).alias("run")))
    probes = checkpoint(right.select("kb", "digits", F.explode(runs(F.col("kb"), F.lit(1), 1)).alias("r")).select("kb", "digits", "r.at", "r.run"))
    often = probes.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    cut = left.select("ka", "digits", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("cut"))
    cut = cut.select("ka", "digits", "cut", F.explode(runs(F.col("ka"), F.col("cut"), 3)).alias("r")).select("ka", "digits", "cut", "r.at", "r.run").join(often, "run", "left")
    rank = F.row_number().over(W.partitionBy("ka", "cut").orderBy(F.coalesce("n", F.lit(0)), "at"))
    rare = cut.withColumn("rank", rank).filter("rank <= 3 and n is not null").select("ka", "digits", "run", F.col("at").alias("a")).distinct()
    met = salted_join(probes, rare, ["run", "digits"], F.col("kb"))
    return met.filter(F.abs(F.col("at") - F.col("a")) <= 2).select("ka", "kb")


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, ka, kb) whose keys (a, key) and (b, key) aren't equal, differ by two slips or fewer, by one if either is shorter than LONG, and have
    the same digits.  Keys shorter than SHORT have no near ones.

    Keys meet in three ways by length: short ones by what is left without one character, middling ones without two, ones of SEGMENTED
    characters or more, of which the former would be ever more, by their rarest segments.  Names of drugs stay below it: made of few
    syllables and endings, they would share their rarest segments with ever more others."""
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    n = lambda c: F.length(c)
    la, rb = (checkpoint(s.filter(n("key") >= SHORT).select("key").distinct().repartition(parts, "key").select(F.col("key").alias(k), F.regexp_replace("key", "[^0-9]", "").alias("digits"))) for s, k in ((left, "ka"), (right, "kb")))
    met = None
    for only, also, strings in ((n("ka") <= LONG, n("kb") <= LONG, shortened), (n("ka").between(LONG, SEGMENTED - 1), n("kb").between(LONG, SEGMENTED + 1), _twice)):
        # Spark sizes the exploded sides by what they come from and would broadcast them: merge them instead.
        sides = [df.filter(keep).select(k, "digits", F.explode(F.transform(strings(F.col(k)), lambda x: F.xxhash64(x))).alias("h")) for df, keep, k in ((la, only, "ka"), (rb, also, "kb"))]
        part = sides[0].join(sides[1].hint("merge"), ["h", "digits"]).select("ka", "kb")
        met = part if met is None else met.unionByName(part)
    met = met.unionByName(_met_by_segments(la.filter(n("ka") >= SEGMENTED), rb.filter(n("kb") >= SEGMENTED - 2)))
    met = met.filter((F.col("ka") != F.col("kb")) & (F.abs(n("ka") - n("kb")) <= 2)).distinct()
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    # The bounded distance is cheap and rules out nearly all; only what is left has its letters sorted.
    d = F.levenshtein("ka", "kb", 4)
    same = lambda: letters(F.col("ka")) == letters(F.col("kb"))
    # Of a distance above two, exchanges are a part: then the keys have a string of two characters fewer in common.
    exchanged = F.when(d == 3, F.levenshtein(letters(F.col("ka")), letters(F.col("kb"))) <= 2).otherwise(same())
    long = F.when(d < 0, False).when(d <= 2, True).when(exchanged, F.arrays_overlap(_twice(F.col("ka")), _twice(F.col("kb")))).otherwise(False)
    short = F.when((d == 0) | (d == 1), True).when(d == 2, same()).otherwise(False)
    keys = checkpoint(met.filter(F.when(F.least(F.length("ka"), F.length("kb")) >= LONG, long).otherwise(short)))
    ends = salted_join(left.select("a", F.col("key").alias("ka")), keys, ["ka"], F.col("a"))
    return salted_join(ends, right.select("b", F.col("key").alias("kb")), ["kb"], F.col("a")).select("a", "b", "ka", "kb").distinct()


def _partners(rest: Column, spread: Column, further: float) -> Column:
    """Log-odds a factor tells a pair, from what its other pairs say.

    The factor weighs a record with k partners ``further`` ** max(0, k - 1).  With q the odds of each other pair,
    ``rest`` is the sum of q and ``spread`` that of log(1 + further q): over all subsets of the others the pair's
    own presence gives prod(1 + further q), its absence 1 + (prod(1 + further q) - 1) / further."""
    if further == 1.0:
        return F.lit(0.0)
    if further == 0.0:
        return -F.log1p(F.greatest(F.lit(0.0), rest))
    g = F.least(F.lit(300.0), F.greatest(F.lit(0.0), spread))
    return g - F.log1p(F.expm1(g) / further)


def believe(pairs: DataFrame, *, further_a: float = FURTHER_A, further_b: float = FURTHER_B, rounds: int = 1000, damping: float = 0.5, tolerance: float = 1e-3, one_task: int = 1_000_000) -> DataFrame:
    """Marginal probability of each candidate pair: (a, b, confidence).

    ``pairs``: (a, b, theta) with each pair once and its log-odds.  A factor on each a, and one on each b, weighs
    each partner after the first: 0 forbids it, 1 doesn't mind.  A pair tells a factor its odds from
    all else, and a factor answers with what the other pairs leave; rounds end when no message moves by more
    than ``tolerance``.  Exact where the pairs form no cycle.  Messages of a graph that hasn't settled after
    ``rounds`` are an error, not a result.  An empty table gives an empty result.

    A pair whose ends have no other gets no message and leaves at once.  Of the others up to ``one_task``, as counted,
    exchange messages within one task; of more, each round is a join.
    """
    pairs = checkpoint(pairs.select("a", "b", "theta"))
    many = [pairs.groupBy(c).agg(F.count(F.lit(1)).alias(f"n{c}")) for c in ("a", "b")]
    counted = checkpoint(pairs.join(many[0], "a").join(many[1], "b").withColumn("alone", (F.col("na") == 1) & (F.col("nb") == 1)).drop("na", "nb"))
    alone = counted.filter("alone").select("a", "b", (1 / (1 + F.exp(-F.col("theta")))).alias("confidence"))
    pairs = counted.filter("not alone").drop("alone")
    n = pairs.count()
    if n == 0:
        return alone
    if n <= one_task:

        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if parts := list(batches):
                p = pd.concat(parts, ignore_index=True)
                p["confidence"] = _settled(pd.factorize(p["a"])[0], pd.factorize(p["b"])[0], p["theta"].to_numpy(), further_a, further_b, rounds, damping, tolerance)
                yield p[["a", "b", "confidence"]]

        kinds = pairs.schema
        return alone.unionByName(checkpoint(pairs.repartition(1).mapInPandas(settle, f"a {kinds['a'].dataType.simpleString()}, b {kinds['b'].dataType.simpleString()}, confidence double")))
    state = checkpoint(pairs.select("a", "b", "theta", F.lit(0.0).alias("ma"), F.lit(0.0).alias("mb")))
    clip = lambda c: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c))
    change = None
    for _ in range(rounds):
        told = state.withColumn("qa", F.exp(clip(F.col("theta") + F.col("mb")))).withColumn("qb", F.exp(clip(F.col("theta") + F.col("ma"))))
        j = told
        for side, w in (("a", further_a), ("b", further_b)):
            sums = told.groupBy(side).agg(F.sum(f"q{side}").alias(f"s{side}"), F.sum(F.log1p(F.col(f"q{side}") * w)).alias(f"l{side}"))
            j = j.join(sums, side).withColumn(f"n{side}", _partners(F.col(f"s{side}") - F.col(f"q{side}"), F.col(f"l{side}") - F.log1p(F.col(f"q{side}") * w), w))
        moved = F.greatest(F.abs(F.col("na") - F.col("ma")), F.abs(F.col("nb") - F.col("mb")))
        done = checkpoint(j.select("a", "b", "theta", *[(F.col(m) * damping + F.col(n) * (1 - damping)).alias(m) for m, n in (("ma", "na"), ("mb", "nb"))], moved.alias("moved")))
        change = done.agg(F.max("moved")).first()[0]
        state = done.drop("moved")
        if change is None or change <= tolerance:
            return alone.unionByName(state.select("a", "b", (1 / (1 + F.exp(-(F.col("theta") + F.col("ma") + F.col("mb"))))).alias("confidence")))
    raise RuntimeError(f"messages still move by {change} after {rounds} rounds")


def _settled(a: np.ndarray, b: np.ndarray, theta: np.ndarray, further_a: float, further_b: float, rounds: int, damping: float, tolerance: float) -> np.ndarray:
    """The same messages for pairs held in memory, their ends as numbers from 0: the confidence of each."""

    def answer(end: np.ndarray, q: np.ndarray, further: float) -> np.ndarray:
        if further == 1.0:
            return np.zeros(len(q))
        if further == 0.0:
            return -np.log1p(np.maximum(0.0, np.bincount(end, q)[end] - q))
        x = np.log1p(q * further)
        g = np.minimum(300.0, np.maximum(0.0, np.bincount(end, x)[end] - x))
        return g - np.log1p(np.expm1(g) / further)

    ma, mb, moved = np.zeros(len(theta)), np.zeros(len(theta)), 0.0
    for _ in range(rounds):
        na, nb = answer(a, np.exp(np.clip(theta + mb, -30, 30)), further_a), answer(b, np.exp(np.clip(theta + ma, -30, 30)), further_b)
        moved = max(np.abs(na - ma).max(), np.abs(nb - mb).max())
        ma, mb = ma * damping + na * (1 - damping), mb * damping + nb * (1 - damping)
        if moved <= tolerance:
            return 1 / (1 + np.exp(-(theta + ma + mb)))
    raise RuntimeError(f"messages still move by {moved} after {rounds} rounds")


def _evidence(parts: list[DataFrame]) -> DataFrame:
    """Sum of the strongest weight by kind of evidence: (a, b, theta)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("a", "b", "kind").agg(F.max("weight").alias("weight")).groupBy("a", "b").agg((F.sum("weight") + PRIOR).alias("theta"))


def _pairs(left: DataFrame, right: DataFrame, kind: str, weight: float) -> DataFrame:
    return salted_join(left, right, ["key"], F.col("a")).select("a", "b").distinct().select("a", "b", F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))


def _nearness() -> Column:
    return F.when(F.least(F.length("ka"), F.length("kb")) >= LONG, NEAR).otherwise(NEAR_SHORT)


def _attribute(candidates: DataFrame, left: DataFrame, right: DataFrame, kind: str, agree: float, differ: float) -> DataFrame:
    """Evidence from an attribute (a or b, value): any shared value agrees, two known values none of which is shared differ."""
    lv, rv = (s.filter("value is not null").groupBy(k).agg(F.sort_array(F.collect_set("value")).alias(n)) for s, k, n in ((left, "a", "va"), (right, "b", "vb")))
    j = candidates.join(lv, "a").join(rv, "b")
    return j.select("a", "b", F.lit(kind).alias("kind"), F.when(F.arrays_overlap("va", "vb"), agree).otherwise(differ).alias("weight"))


def match_drugs(drugs: DataFrame, products: DataFrame) -> DataFrame:
    """(a, b, confidence): chembl_id of ``drugs`` and drug_id of ``products`` that are one active molecule.

    Drugs: chembl_id, name, synonyms, mechanism, max_phase; products: drug_id, drug_name, mechanism, phase, several
    rows for one drug_id.  Names are compared without salt, strength, form and trade name.  Rows without id or
    any name match nothing; repeated rows count once."""
    names = drugs.select(F.col("chembl_id").alias("a"), F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("n"))
    left = checkpoint(names.select("a", substance(F.col("n")).alias("key")).dropna().distinct())
    right = checkpoint(products.select(F.col("drug_id").alias("b"), substance(F.col("drug_name")).alias("key")).dropna().distinct())
    exact = checkpoint(_pairs(left, right, "name", SAME))
    stem = lambda c: F.regexp_extract(c, f"({STEMS})$", 1)
    other = (stem(F.col("ka")) != "") & (stem(F.col("kb")) != "") & (stem(F.col("ka")) != stem(F.col("kb")))
    near = near_pairs(left, right).select("a", "b", F.lit("name").alias("kind"), (_nearness() + F.when(other, STEM).otherwise(0.0)).alias("weight"))
    named = checkpoint(exact.unionByName(near))
    pairs = named.select("a", "b").distinct()
    mech = _attribute(pairs, drugs.select(F.col("chembl_id").alias("a"), mechanism_key(F.col("mechanism")).alias("value")), products.select(F.col("drug_id").alias("b"), mechanism_key(F.col("mechanism")).alias("value")), "mechanism", AGREE, DISAGREE)
    phase = _attribute(pairs, drugs.select(F.col("chembl_id").alias("a"), F.col("max_phase").alias("value")), products.select(F.col("drug_id").alias("b"), F.col("phase").alias("value")), "phase", 0.5, -0.5)
    return believe(_evidence([named, mech, phase]))


def match_genes(genes: DataFrame, proteins: DataFrame) -> DataFrame:
    """(a, b, confidence): ensembl_id of ``genes`` and accession of the human ``proteins`` made by that gene.

    Genes: ensembl_id, symbol, name, description (with a former symbol); proteins: accession, protein_name, gene_names,
    organism.  Proteins of other or unknown organisms match nothing; repeated rows count once."""
    human = proteins.filter(plain(F.col("organism")).rlike(r"\b(homo sapiens|h\. sapiens|human)\b"))
    sym_l = genes.select(F.col("ensembl_id").alias("a"), symbol_key(F.col("symbol")).alias("key")).dropna().distinct()
    old_l = genes.select(F.col("ensembl_id").alias("a"), symbol_key(F.regexp_extract("description", r"formerly (\S+?)\.?$", 1)).alias("key")).dropna().distinct()
    sym_r = human.select(F.col("accession").alias("b"), F.explode("gene_names").alias("g")).select("b", symbol_key(F.col("g")).alias("key")).dropna().distinct()
    name_l = genes.select(F.col("ensembl_id").alias("a"), F.explode(F.array("name", F.regexp_replace("description", "; formerly .*$", ""))).alias("n")).select("a", gene_name_key(F.col("n")).alias("key")).dropna().distinct()
    name_r = human.select(F.col("accession").alias("b"), gene_name_key(F.col("protein_name")).alias("key")).dropna().distinct()
    exact = checkpoint(_pairs(sym_l, sym_r, "symbol", SAME).unionByName(_pairs(old_l, sym_r, "symbol", ALIAS)).unionByName(_pairs(name_l, name_r, "name", SAME)))
    near = near_pairs(name_l, name_r).select("a", "b", F.lit("name").alias("kind"), _nearness().alias("weight"))
    return believe(_evidence([exact, near]))
