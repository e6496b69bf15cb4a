"""Landing-zone readers: raw JSON and XML payloads of the sources as typed rows.

Each takes a DataFrame with a column ``payload`` (one response each) and skips what is malformed or missing, as
``from_json`` and ``from_xml`` do in permissive mode; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("payload", schema).alias("j"))


def pubmed_ids(df: DataFrame) -> DataFrame:
    """(pos, pmid) of search responses, in order."""
    return _json(df, "esearchresult struct<idlist: array<string>>").select(F.posexplode("j.esearchresult.idlist").alias("pos", "pmid"))


_ARTICLE = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>,"
    " AuthorList: struct<Author: array<struct<CollectiveName: string, LastName: string, Initials: string>>>, ArticleDate: array<struct<Year: string>>>,"
    " MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: string>>>, KeywordList: struct<Keyword: array<string>>>,"
    " PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>"
)


def pubmed_articles(df: DataFrame) -> DataFrame:
    """Articles of PubmedArticleSet documents: pmid, title, abstract, journal, authors, year, mesh_terms, doi, keywords."""
    doc = df.select(F.from_xml("payload", f"PubmedArticle array<struct<{_struct(_ARTICLE)}>>").alias("x")).select(F.explode("x.PubmedArticle").alias("a"))
    m, art = F.col("a.MedlineCitation"), F.col("a.MedlineCitation.Article")
    full = lambda x: F.array_compact(F.transform(x, lambda t: F.when(F.trim(t) != "", F.trim(t))))
    author = lambda u: F.coalesce(u["CollectiveName"], F.when(u["Initials"].isNotNull(), F.concat_ws(" ", u["LastName"], u["Initials"])).otherwise(u["LastName"]))
    year = F.coalesce(*[F.when(y.rlike(r"^\d+$"), y.cast("int")) for y in (art["Journal"]["JournalIssue"]["PubDate"]["Year"], F.try_element_at(art["ArticleDate"], F.lit(1))["Year"])])
    doi = F.try_element_at(F.filter(F.col("a.PubmedData.ArticleIdList.ArticleId"), lambda i: i["_IdType"] == "doi"), F.lit(1))["_VALUE"]
    return doc.select(
        m["PMID"].alias("pmid"), F.trim(art["ArticleTitle"]).alias("title"), F.array_join(full(art["Abstract"]["AbstractText"]), "\n").alias("abstract"),
        art["Journal"]["Title"].alias("journal"), F.array_compact(F.transform(art["AuthorList"]["Author"], author)).alias("authors"), year.alias("year"),
        F.transform(m["MeshHeadingList"]["MeshHeading"], lambda h: h["DescriptorName"]).alias("mesh_terms"), doi.alias("doi"), m["KeywordList"]["Keyword"].alias("keywords"),
    )


def _struct(fields: str) -> str:
    """'a type, b type' as the inside of a struct: 'a: type, b: type'."""
    out, depth, start, parts = [], 0, 0, []
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(fields[start:i])
            start = i + 1
    parts.append(fields[start:])
    for p in parts:
        name, kind = p.strip().split(" ", 1)
        out.append(f"{name}: {kind}")
    return ", ".join(out)


def annotations(df: DataFrame) -> DataFrame:
    """Annotations of documents' passages, each with its first location: (document, text, type, identifier, offset, length)."""
    schema = "documents array<struct<id: string, passages: array<struct<annotations: array<struct<text: string, infons: struct<type: string, identifier: string>, locations: array<struct<offset: int, length: int>>>>>>>>"
    d = _json(df, schema).select(F.explode("j.documents").alias("d")).select("d.id", F.explode("d.passages").alias("p")).select("id", F.explode("p.annotations").alias("a"))
    loc = F.try_element_at("a.locations", F.lit(1))
    return d.select(F.col("id").alias("document"), "a.text", "a.infons.type", "a.infons.identifier", loc["offset"].alias("offset"), loc["length"].alias("length"))


def gene_info(df: DataFrame) -> DataFrame:
    j = _json(df, "data struct<target: struct<id: string, approvedSymbol: string, approvedName: string, biotype: string, functionDescriptions: array<string>>>").select("j.data.target.*")
    return j.filter("id is not null").select(F.col("id").alias("ensembl_id"), F.col("approvedSymbol").alias("symbol"), F.col("approvedName").alias("name"), "biotype", F.try_element_at("functionDescriptions", F.lit(1)).alias("description"))


def gene_diseases(df: DataFrame) -> DataFrame:
    schema = "data struct<target: struct<id: string, associatedDiseases: struct<rows: array<struct<disease: struct<id: string, name: string>, score: double, datasourceScores: array<struct<id: string, score: double>>>>>>>"
    r = _json(df, schema).select("j.data.target.id", F.explode("j.data.target.associatedDiseases.rows").alias("r"))
    return r.select(F.col("id").alias("ensembl_id"), F.col("r.disease.id").alias("disease_id"), F.col("r.disease.name").alias("disease_name"), "r.score", F.coalesce(F.size("r.datasourceScores"), F.lit(0)).alias("evidence_count"))


def tractability(df: DataFrame) -> DataFrame:
    t = _json(df, "data struct<target: struct<id: string, tractability: array<struct<modality: string, label: string, value: boolean>>>>")
    return t.select("j.data.target.id", F.explode("j.data.target.tractability").alias("t")).select(F.col("id").alias("ensembl_id"), "t.modality", "t.label", "t.value")


def disease_drugs(df: DataFrame) -> DataFrame:
    schema = "data struct<disease: struct<id: string, knownDrugs: struct<rows: array<struct<drug: struct<id: string, name: string>, phase: double, status: string, mechanismOfAction: string>>>>>"
    r = _json(df, schema).select("j.data.disease.id", F.explode("j.data.disease.knownDrugs.rows").alias("r"))
    return r.select(F.col("id").alias("disease_id"), F.col("r.drug.id").alias("drug_id"), F.col("r.drug.name").alias("drug_name"), F.col("r.phase").cast("int").alias("phase"), "r.status", F.col("r.mechanismOfAction").alias("mechanism"))


def molecules(df: DataFrame) -> DataFrame:
    j = _json(df, "molecule_chembl_id string, pref_name string, max_phase string, molecule_type string").select("j.*")
    return j.filter("molecule_chembl_id is not null").select(F.col("molecule_chembl_id").alias("chembl_id"), F.col("pref_name").alias("name"), F.expr("cast(try_cast(max_phase as double) as int)").alias("max_phase"), "molecule_type")


def first_molecules(df: DataFrame, *, id: str = "molecule_chembl_id", seq: str = "seq") -> DataFrame:
    """One row for each molecule, the first by ``seq``; blank ids are dropped."""
    rest = [c for c in df.columns if c != id]
    return df.filter(F.trim(id) != "").groupBy(id).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(id, "r.*")


def activities(df: DataFrame) -> DataFrame:
    j = _json(df, "activities array<struct<assay_chembl_id: string, standard_type: string, standard_value: string, standard_units: string>>").select(F.explode("j.activities").alias("a"))
    return j.select("a.assay_chembl_id", F.col("a.standard_type").alias("activity_type"), F.expr("try_cast(a.standard_value as double)").alias("activity_value"), F.col("a.standard_units").alias("units"))


def proteins(df: DataFrame) -> DataFrame:
    schema = "results array<struct<primaryAccession: string, proteinDescription: struct<recommendedName: struct<fullName: struct<value: string>>>, genes: array<struct<geneName: struct<value: string>>>, organism: struct<scientificName: string>, sequence: struct<length: int>>>"
    r = _json(df, schema).select(F.explode("j.results").alias("r"))
    return r.select(F.col("r.primaryAccession").alias("accession"), F.col("r.proteinDescription.recommendedName.fullName.value").alias("protein_name"), F.transform("r.genes", lambda g: g["geneName"]["value"]).alias("gene_names"), F.col("r.organism.scientificName").alias("organism"), F.col("r.sequence.length").alias("length"))


def interactions(df: DataFrame) -> DataFrame:
    """Interaction network responses, a list or an object with ``network``: (protein_a, protein_b, score)."""
    row = "struct<preferredName_A: string, preferredName_B: string, score: double>"
    listed = F.when(F.ltrim("payload").startswith("["), F.from_json("payload", f"array<{row}>")).otherwise(F.from_json("payload", f"network array<{row}>")["network"])
    return df.select(F.explode(listed).alias("r")).select(F.col("r.preferredName_A").alias("protein_a"), F.col("r.preferredName_B").alias("protein_b"), "r.score").filter("protein_a is not null and protein_b is not null")


def drug_pairs(df: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Interacting pairs of nested interaction responses with two concepts at least: (source, rxcui_a, drug_a, rxcui_b, drug_b, description)."""
    item = "struct<minConceptItem: struct<rxcui: string, name: string>>"
    schema = f"fullInteractionTypeGroup array<struct<sourceName: string, fullInteractionType: array<struct<interactionPair: array<struct<description: string, interactionConcept: array<{item}>>>>>>>"
    p = _json(df, schema).select(F.explode("j.fullInteractionTypeGroup").alias("g")).select("g.sourceName", F.explode("g.fullInteractionType").alias("t")).select("sourceName", F.explode("t.interactionPair").alias("p")).filter(F.size("p.interactionConcept") >= 2)
    a, b = (F.col("p.interactionConcept")[i]["minConceptItem"] for i in (0, 1))
    out = p.select(F.col("sourceName").alias("source"), a["rxcui"].alias("rxcui_a"), a["name"].alias("drug_a"), b["rxcui"].alias("rxcui_b"), b["name"].alias("drug_b"), "p.description")
    if wanted is not None:
        for c in ("rxcui_a", "rxcui_b"):
            out = out.join(wanted.select(F.col("rxcui").alias(c)).distinct(), c, "left_semi")
    return out


def ndc_codes(df: DataFrame) -> DataFrame:
    """All codes of a history response, sorted, each once: (codes)."""
    j = _json(df, "historicalNdcConcept struct<historicalNdcTime: array<struct<ndcTime: array<struct<ndc: array<string>>>>>>")
    codes = F.flatten(F.flatten(F.transform("j.historicalNdcConcept.historicalNdcTime", lambda t: F.transform(t["ndcTime"], lambda n: n["ndc"]))))
    return j.select(F.array_sort(F.array_distinct(F.array_compact(codes))).alias("codes"))


def event_reactions(df: DataFrame) -> DataFrame:
    """Reactions of adverse event responses: (event, reaction), lower case, each once for an event."""
    e = _json(df, "results array<struct<patient: struct<reaction: array<struct<reactionmeddrapt: string>>>>>").select(F.posexplode("j.results").alias("event", "r"))
    return e.select("event", F.explode("r.patient.reaction").alias("x")).select("event", F.lower("x.reactionmeddrapt").alias("reaction")).dropna().distinct()


def label_section(fields: list[str], size: int = 280) -> Column:
    """First ``size`` characters of a label's sections (arrays of text) put together."""
    return F.substring(F.array_join(F.flatten(F.array(*[F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields])), " "), 1, size)


def mechanisms(df: DataFrame) -> DataFrame:
    """Mechanisms of mechanism responses: (molecule_chembl_id, target_chembl_id, mechanism, action_type), a missing target as ''."""
    j = _json(df, "mechanisms array<struct<molecule_chembl_id: string, target_chembl_id: string, mechanism_of_action: string, action_type: string>>").select(F.explode("j.mechanisms").alias("m"))
    return j.select("m.molecule_chembl_id", F.coalesce("m.target_chembl_id", F.lit("")).alias("target_chembl_id"), F.col("m.mechanism_of_action").alias("mechanism"), "m.action_type")


def drug_records(df: DataFrame, bundled: DataFrame, *, limit: int) -> DataFrame:
    """The first ``limit`` records of each drug's response (drug, payload) as JSON texts: (drug, pos, record); bundled ones (drug, pos, record) where there is none.

    Serves adverse events (10), labels (5) and recalls (10) alike; entries that aren't objects are left out."""
    found = df.select("drug", F.posexplode(F.filter(F.from_json("payload", "results array<string>")["results"], lambda r: r.startswith("{"))).alias("pos", "record"))
    found = found.filter(F.col("pos") < limit)
    return found.unionByName(bundled.join(found.select("drug").distinct(), "drug", "left_anti").select("drug", "pos", "record"))


def known_interactions(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Known interactions (id_a, id_b, …) among the members of each list (list, id): each unordered pair once for a list.

    Members meet the known pairs by equality, so the pairs of a list are never all formed."""
    m = lists.select("list", "id").distinct()
    rest = [c for c in known.columns if c not in ("id_a", "id_b")]
    k = known.filter("id_a <> id_b").groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(*[F.min(c).alias(c) for c in rest])
    return k.join(m.withColumnRenamed("id", "id_a"), "id_a").join(m.withColumnRenamed("id", "id_b"), ["list", "id_b"], "left_semi").select("list", "id_a", "id_b", *rest)


def phenotype_diseases(wanted: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Diseases of phenotypes (phenotype): from the local list (phenotype, disease, score) if it has the phenotype, else from the remote one."""
    w = wanted.select("phenotype").distinct()
    here = local.join(w, "phenotype", "left_semi").select("phenotype", "disease", "score")
    there = remote.join(w, "phenotype", "left_semi").join(local.select("phenotype").distinct(), "phenotype", "left_anti").select("phenotype", "disease", "score")
    return here.unionByName(there)
