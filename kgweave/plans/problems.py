"""Queries of the general training-data problems (5 and 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import orphans, units
from ..operators.runtime import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.to_picomolar(
        table(spark, d, "bioactivities"), table(spark, d, "chembl_drugs"),
        id="activity_id", kind="activity_type", value="activity_value", units="units", comment="activity_comment",
        molecule="molecule_chembl_id", weight_key="chembl_id", weight="mol_weight",
    )


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(
        table(spark, d, "kg_edges"), table(spark, d, "kg_nodes"),
        child_key="edge_id", child_time="loaded_at", reference_columns={"source": "source_id", "target": "target_id"},
        parent_key="id", parent_loaded="loaded_at", parent_deleted="deleted_at",
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("edge_id", "side", "kind")


def p7_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d), "loaded_at")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found, "p7_found": p7_found, "p7_by_month": p7_by_month}


_ORPHANS = """
WITH e AS (SELECT DISTINCT edge_id, source_id, target_id, loaded_at FROM kg_edges),
r AS (SELECT edge_id, loaded_at, 'source' AS side, source_id AS ref FROM e UNION ALL SELECT edge_id, loaded_at, 'target', target_id FROM e),
n AS (SELECT id, min(loaded_at) AS first_loaded, min(deleted_at) AS first_deleted FROM kg_nodes GROUP BY id),
o AS (SELECT DISTINCT edge_id, side, r.loaded_at,
      CASE WHEN n.id IS NULL THEN 'missing' WHEN n.first_loaded > r.loaded_at THEN 'late' WHEN n.first_deleted <= r.loaded_at THEN 'deleted' END AS kind
      FROM r LEFT JOIN n ON n.id = r.ref WHERE r.ref IS NOT NULL AND trim(r.ref, ' \t\n') <> '')
"""
SQL = {
    "p7_found": _ORPHANS + "SELECT DISTINCT edge_id, side, kind FROM o WHERE kind IS NOT NULL",
    "p7_by_month": _ORPHANS + "SELECT side, kind, strftime(m, '%Y-%m') AS month, count(*) AS n FROM (SELECT edge_id, side, kind, min(loaded_at) AS m FROM o WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY ALL",
}
