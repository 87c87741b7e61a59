"""One analysis run: every artifact from the tables of a folder, each failing alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.plans import collection as L
from refweave.plans import comparisons as C
from refweave.plans import domain as D
from refweave.plans import figures as V
from refweave.plans import graph_metrics as G
from refweave.plans import temporal_metrics as M
from refweave.plans import workflow_metrics as W
from refweave.sources.files import Report, missing_inputs

Query = Callable[[SparkSession, str], DataFrame]
INPUTS = ["repositories", "actions", "workflows", "edges", "workflow_changes", "ref_observations", "tag_observations"]

# The names of the artifacts, in the order in which they are written.
ARTIFACTS: dict[str, Query] = {
    "cdg_edges": D.edges,
    "workflow_implicit_ratio": G.implicit_ratio,
    "cascade_depth_report": G.cascade_depth,
    "drift_distribution": M.drift_distribution,
    "drift_events": M.drift_merged,
    "drift_events_enriched": M.drift_enriched,
    "drift_observation_coverage": M.drift_coverage,
    "repository_transfer_risks": L.transfer_risks_ordered,
    "repository_transfer_summary": M.transfer_summary,
    "trust_domain_boundaries": G.trust_boundaries,
    "trust_domain_boundary_summary": G.trust_boundary_summary,
    "discovery_risk_candidates": W.discovery_candidates,
    "discovery_risk_summary": W.discovery_summary,
    "reusable_workflow_edges": W.reusable_calls,
    "reusable_workflow_summary": W.reusable_summary,
    "reusable_workflow_top_callees": W.reusable_callees,
    "reusable_workflow_risk_profile": W.reusable_profile,
    "isolation_risk_by_job": W.isolation_by_job,
    "isolation_risk_summary": W.isolation_summary,
    "isolation_risk_examples": W.isolation_examples,
    "privilege_risk_by_workflow": W.privilege_by_workflow,
    "privilege_risk_by_job": W.privilege_by_job,
    "privilege_risk_summary": W.privilege_summary,
    "privilege_risk_examples": W.privilege_examples,
    "propagation_risk_by_workflow": W.propagation_by_workflow,
    "propagation_risk_summary": W.propagation_summary,
    "propagation_risk_examples": W.propagation_examples,
    "trust_amplification_by_entity": C.trust_amplification_by_entity,
    "trust_amplification_summary": C.trust_amplification_summary,
    "trust_amplification_top_entities": C.trust_top_entities,
    "privileged_blast_radius_by_action": C.privileged_blast,
    "privileged_blast_radius_summary": C.privileged_blast_summary,
    "component_type_comparison": C.component_types,
    "bootstrap_indicators": C.bootstrap_indicators,
    "cross_owner_effects": C.cross_owner_intervals,
    "manual_validation_candidates": C.manual_validation,
    "ref_risk_by_workflow": G.ref_risk_by_workflow,
    "ref_risk_summary": G.ref_risk_summary,
    "ref_risk_by_depth": G.ref_risk_by_depth,
    "ref_risk_by_action": G.ref_risk_by_action,
    "ref_type_risk_comparison": C.ref_type_comparison,
    "cross_owner_comparison": C.lift_cross_same,
    "blast_radius": G.blast_radius,
    "amplification_by_node": G.amplification_by_node,
    "amplification_summary": G.amplification_summary,
    "amplification_top_nodes": V.top_amplifiers,
    "exposure_windows": M.exposure,
    "exposure_window_summary": M.exposure_summary,
    "update_windows": L.update_windows_ordered,
    "update_window_summary": M.update_window_summary,
    "time_window_amplification": M.time_window_amplification,
}
SUMMARIES = tuple(n for n in ARTIFACTS if n.endswith("_summary") or n.endswith("_coverage"))


def summary_report(spark: SparkSession, folder: str) -> DataFrame:
    """The summaries together: artifact and its rows as JSON."""
    parts = []
    for name in SUMMARIES:
        df = ARTIFACTS[name](spark, folder)
        parts.append(df.select(F.lit(name).alias("artifact"), F.to_json(F.struct(*df.columns)).alias("row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def artifacts() -> dict[str, Query]:
    """Everything a run writes: the tables and the report of their summaries."""
    return {"report": summary_report} | ARTIFACTS


def run(spark: SparkSession, data: str, out: str, formats: tuple[str, ...] = ("csv", "json"), only: dict[str, Query] | None = None) -> DataFrame:
    """Writes every artifact below ``out`` and returns artifact, status and message; what fails is noted, the rest is written.

    Refuses to start where an input table is missing, and names it.
    """
    gone = missing_inputs(spark, data, [f"{n}.parquet" for n in INPUTS])
    if gone:
        raise FileNotFoundError(f"missing inputs: {', '.join(gone)}")
    return Report({name: (lambda q=q: q(spark, data)) for name, q in (only or artifacts()).items()}).export(spark, out, formats)
