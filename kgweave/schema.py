"""The graph's fixed vocabulary: node and edge types and their constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NODE_TYPES = ("Gene", "Protein", "Disease", "Drug", "Compound", "Pathway", "Phenotype", "CellType", "Tissue", "SideEffect", "ClinicalTrial", "Publication")
EDGE_TYPES = (
    "gene_associated_with_disease", "gene_in_pathway", "gene_interacts_with_gene", "protein_interacts_with_protein",
    "drug_targets_gene", "drug_treats_disease", "drug_interacts_with_drug", "drug_causes_side_effect",
    "compound_binds_target", "disease_has_phenotype", "disease_involves_pathway", "gene_expressed_in_tissue",
    "pathway_crosstalks_with", "publication_mentions_gene", "publication_mentions_disease", "drug_contraindicated_for",
    "gene_associated_with_phenotype", "trial_investigates_drug",
)
DEFAULT_NODE_TYPE, DEFAULT_EDGE_TYPE = "Gene", "gene_interacts_with_gene"
#: Relation between a source and a target type, where one can be told from the types alone.
EDGE_BETWEEN = {
    ("Gene", "Disease"): "gene_associated_with_disease", ("Gene", "Pathway"): "gene_in_pathway", ("Gene", "Gene"): "gene_interacts_with_gene",
    ("Drug", "Gene"): "drug_targets_gene", ("Drug", "Disease"): "drug_treats_disease", ("Disease", "Phenotype"): "disease_has_phenotype",
    ("Disease", "Pathway"): "disease_involves_pathway", ("Publication", "Gene"): "publication_mentions_gene", ("Publication", "Disease"): "publication_mentions_disease",
}


def checked(column: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value if allowed, the default for null, an error for any other."""
    return F.when(column.isNull(), default).when(column.isin(*allowed), column).otherwise(F.raise_error(F.concat(F.lit("not a known type: "), column)).cast("string"))


def edge_type_between(source_type: Column, target_type: Column) -> Column:
    """The relation two node types imply, null where none does."""
    pairs = F.create_map(*[F.lit(x) for (s, t), e in EDGE_BETWEEN.items() for x in (f"{s}>{t}", e)])
    return F.try_element_at(pairs, F.concat_ws(">", source_type, target_type))
