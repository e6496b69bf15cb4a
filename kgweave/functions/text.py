"""Text rules as column expressions: citations, sentences, claims, requests, evidence, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a request's kind, in the order in which kinds are preferred.
KEYWORDS = {
    "literature": ["pubmed", "paper", "publication", "literature", "citation", "review"],
    "graph_explorer": ["graph", "network", "path", "subgraph", "neighbor", "traverse"],
    "link_predictor": ["predict link", "novel link", "missing edge", "link prediction"],
    "drug_repurposer": ["repurpose", "reposition", "new indication", "candidate drug"],
    "geneticist": ["gene", "variant", "mutation", "biomarker", "druggability"],
    "pharmacologist": ["ddi", "interaction", "pharmacokinetic", "admet", "contraindication", "metabolism"],
    "clinician": ["symptom", "diagnosis", "patient", "phenotype", "hpo", "differential"],
    "pathway_analyst": ["pathway", "enrichment", "signaling", "crosstalk"],
    "hypothesis_generator": ["hypothesis", "novel mechanism", "structural hole"],
    "review_writer": ["write review", "narrative review", "draft review"],
    "sentinel": ["verify", "validate", "hallucination", "fact-check"],
}
# Signs of several steps, and verbs that begin a clause.
COMPLEX = [" then ", " compare ", " plus ", "multi-agent", "workflow"]
CLAUSE_VERBS = "what|which|are there|is there|find|show|check|analyze|analyse|generate|draft|verify|list"
# Words that tell the level of evidence, and its score.
EVIDENCE = [
    (["systematic review", "meta-analysis"], "high", 0.9),
    (["randomized", "phase 3", "clinical trial"], "moderate", 0.75),
    (["cohort", "case-control", "observational"], "low", 0.55),
    (["case report", "preclinical", "mouse", "in vitro"], "very_low", 0.3),
]
EVIDENCE_ELSE = ("low", 0.45)
# Levels of severity, lowest first, words and synonyms that tell them, and the advice for each.
SEVERITIES = ["minor", "moderate", "major", "contraindicated"]
SEVERITY_WORDS = [
    (["contraindicated", "avoid combination"], "contraindicated"),
    (["life-threatening", "severe", "major"], "major"),
    (["monitor", "moderate", "dose adjustment"], "moderate"),
]
SEVERITY_SYNONYMS = {"contraindicated": "contraindicated", "avoid": "contraindicated", "major": "major", "severe": "major", "moderate": "moderate", "monitor": "moderate"}
ADVICE = {
    "contraindicated": "Avoid this drug combination.",
    "major": "Use only with specialist oversight or consider alternatives.",
    "moderate": "Monitor closely and consider dose adjustment.",
    "minor": "Routine monitoring is usually sufficient.",
}
CITATION = r"\[(?:PMID:)?(\d+)\]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-case text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def task_weights(text: Column) -> Column:
    """Array of (weight, place, task): the number of words in a kind's keywords that stand in the text as whole words.

    place falls from one kind to the next, so that the greatest entry is the first kind of those with the greatest weight.
    One look-ahead pattern finds all keywords in one pass over the text, also where they overlap."""
    any_word = "|".join(r"\s+".join(w.split()) for words in KEYWORDS.values() for w in words)
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\b(?=({any_word})\b)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " ")))
    lengths = F.create_map(*[F.lit(x) for words in KEYWORDS.values() for w in words for x in (w, len(w.split()))])
    kinds = F.array(*[F.struct(F.lit(-k).alias("place"), F.lit(kind).alias("task"), F.array(*map(F.lit, words)).alias("words")) for k, (kind, words) in enumerate(KEYWORDS.items())])
    of = lambda hits, own: F.aggregate(F.array_intersect(hits, own), F.lit(0), lambda s, w: s + F.element_at(lengths, w))
    weigh = lambda hits: F.transform(kinds, lambda k: F.struct(of(hits, k["words"]).alias("weight"), k["place"].alias("place"), k["task"].alias("task")))
    return F.transform(F.array(found), weigh)[0]


def classify_task(text: Column) -> Column:
    """Kind of a request: router if it has several steps, else the kind with the greatest weight, the first of equals; null for none."""
    best = F.transform(F.array(F.array_max(task_weights(text))), lambda x: F.when(x["weight"] > 0, x["task"]))[0]
    return F.when(has_any(F.lower(text), COMPLEX), "router").otherwise(best)


def split_clauses(text: Column) -> Column:
    """Clauses of a request, at semicolons, question marks, and commas or 'and' before a verb of asking."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    parts = F.split(t, rf"(?i)(?:;\s*|\?\s*|,\s*(?=(?:{CLAUSE_VERBS})\b)|\band\b(?=\s+(?:{CLAUSE_VERBS})\b))")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[ ,.]+|[ ,.]+$", "")), lambda x: x != "")


def task_priority(task: Column) -> Column:
    return F.when(task.isin("clinician", "pharmacologist", "sentinel"), 3).when(task.isin("literature", "graph_explorer", "geneticist"), 2).otherwise(1)


def cited_pmids(text: Column) -> Column:
    """PMIDs cited in square brackets, each once in the order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))


def invalid_citations(text: Column, available: Column) -> Column:
    return F.array_except(cited_pmids(text), available)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def first_sentence(text: Column) -> Column:
    return F.split(strip(text), r"(?<=[.!?])\s+", 2)[0]


def fallback_queries(text: Column) -> Column:
    """Search strings of a question: itself and up to two quoted phrases, else itself and its first five words of four letters."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_-]{4,}"), F.lit(0))
    return F.when(F.size(quoted) > 0, F.slice(F.concat(F.array(text), quoted), 1, 3)).when(F.size(words) > 0, F.array(text, F.array_join(F.slice(words, 1, 5), " "))).otherwise(F.array(text))


def inline_citation(authors: Column, year: Column) -> Column:
    """Surname and year, 'et al.' for several authors; Unknown and n.d. where missing."""
    n = F.coalesce(F.size(authors), F.lit(0))
    first = F.split(strip(F.try_element_at(authors, F.lit(1))), r"\s+")[0]
    surname = F.coalesce(F.when(n > 0, F.nullif(F.regexp_replace(first, "^,+|,+$", ""), F.lit(""))), F.lit("Unknown"))
    when = F.coalesce(year.cast("string"), F.lit("n.d."))
    return F.concat(surname, F.when(n > 1, " et al., ").otherwise(", "), when)


def evidence_level(text: Column) -> Column:
    t, out = F.lower(text), None
    for words, level, score in EVIDENCE:
        value = F.struct(F.lit(level).alias("level"), F.lit(score).alias("score"))
        out = F.when(has_any(t, words), value) if out is None else out.when(has_any(t, words), value)
    return out.otherwise(F.struct(F.lit(EVIDENCE_ELSE[0]).alias("level"), F.lit(EVIDENCE_ELSE[1]).alias("score")))


def infer_severity(text: Column) -> Column:
    t, out = F.lower(text), None
    for words, level in SEVERITY_WORDS:
        out = F.when(has_any(t, words), level) if out is None else out.when(has_any(t, words), level)
    return out.otherwise("minor")


def coerce_severity(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SEVERITY_SYNONYMS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(text)), F.lit("minor"))


def escalate(severity: Column) -> Column:
    """One level up, the highest stays."""
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.element_at(order, F.least(F.lit(len(SEVERITIES)), F.array_position(order, severity).cast("int") + 1))


def advice(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), severity)


def split_findings(text: Column) -> Column:
    """Findings listed in a text, at commas, semicolons, line ends and the word 'and'."""
    return F.filter(F.transform(F.split(text, r",|;|\n|\band\b"), strip), lambda x: x != "")


def chunk(text: Column, size: int = 180) -> Column:
    """Consecutive pieces of ``size`` characters; an empty text has none."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def slug(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def lenient_json(text: Column) -> Column:
    """A JSON object in a text as a variant: the whole text, else a fenced block, else from its first to its last brace; null if none parses."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))), F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def literature_confidence(documents: Column, invalid: Column, top: int = 5) -> Column:
    score = 0.55 + 0.35 * F.least(documents / top, F.lit(1.0)) - F.when(invalid > 0, 0.2).otherwise(0.0)
    return F.when(documents == 0, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95), score)))


def verification_confidence(claims: Column, supported: Column, issues: Column) -> Column:
    """0.35 + 0.55 of the claims supported, less 0.1 for each issue up to 0.5, between 0 and 0.95; without claims 0.6, or 0.3 with issues."""
    some = F.greatest(F.lit(0.0), F.least(F.lit(0.95), 0.35 + 0.55 * supported / claims - F.least(0.1 * issues, F.lit(0.5))))
    return F.when(claims > 0, some).otherwise(F.when(issues > 0, 0.3).otherwise(0.6))


def critique(text: Column) -> Column:
    """Score of a drafted section: 5, +2 for 80 words, +2.5 for two citations, +0.5 if it doesn't say the evidence is insufficient; at most 10."""
    words = F.size(F.filter(F.split(strip(text), r"(?U)\s+"), lambda x: x != ""))
    s = 5.0 + F.when(words >= 80, 2.0).otherwise(0.0) + F.when(F.size(cited_pmids(text)) >= 2, 2.5).otherwise(0.0) + F.when(~F.lower(text).contains("insufficient evidence"), 0.5).otherwise(0.0)
    return F.least(F.lit(10.0), s)
