"""A whole repository scan: code, dependencies and licences together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.session import cut_lineage
from ..operators import advisories as ad, graph as gr, licenses as lc, manifests as mf
from .scan import scan

COLUMNS = [
    "repo", "file_path", "line", "column", "rule_id", "rule_name", "severity", "confidence", "message", "snippet", "cwe", "owasp", "suggestion",
]


def repository_scan(corpus: DataFrame, advisories: DataFrame, *, mode: str = "pattern", config: dict | None = None) -> dict[str, DataFrame]:
    """Frames ``findings`` (with ``reachable``), ``dependencies``, ``edges`` and ``metrics``.

    Code findings come from a narrow job over the sources; the dependency part
    works on the manifest slice of the corpus, which is small and is best
    written to a table first when the corpus is large.
    """
    entries = cut_lineage(mf.lock_entries(mf.package_locks(corpus)))
    deps = mf.parse_manifests(corpus, entries)
    unique = mf.dedup_dependencies(deps)
    edges = gr.resolve_edges(gr.lock_requirements(entries), deps)
    reached = gr.reachability(edges, gr.import_seeds(gr.imports(corpus), unique))
    sca = gr.flag_reachable(ad.scan_sca(deps, advisories), reached).select(*COLUMNS, "reachable")
    none = F.lit(None).cast("boolean").alias("reachable")
    sast = scan(corpus, mode=mode, config=config).select(*COLUMNS, none)
    licences = lc.license_findings(unique).select(*COLUMNS, none)
    return {
        "findings": sast.unionByName(sca).unionByName(licences),
        "dependencies": unique,
        "edges": edges,
        "metrics": ad.sca_metrics(unique, advisories),
    }
