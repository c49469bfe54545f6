"""Feature pruning on the catalog tables; the data are not read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.layers import (
    Catalog, build_catalog, coverage_cutoff, expand_catalog, flag_layered, node_map, values_on_path,
)
from lamina.operators.rows import normalise_nulls, promote_numeric
from lamina.operators.stats import dense_columns


def section_fields(section_map: DataFrame, sections: Sequence[str] | None = None) -> DataFrame:
    """``(section, field)`` rows of a ``(section, fields array)`` table, optionally of some sections."""
    chosen = section_map if sections is None else section_map.filter(F.col("section").isin(*sections))
    return chosen.select("section", F.explode("fields").alias("field"))


def _with_records(catalog: Catalog, records: DataFrame, step: str) -> Catalog:
    leaves = catalog.leaves.join(records.select(F.col("parent").alias("field")), "field", "left_semi")
    return Catalog(records, catalog.histogram, leaves, (*catalog.history, step))


def prune_features(
    catalog: Catalog, features: Sequence[str] = (), sections: Sequence[str] = (), section_map: DataFrame | None = None
) -> Catalog:
    """Remove records by parent name and by section (catalog sections unless a map is given)."""
    records = catalog.records.filter(~F.col("parent").isin(*features)) if features else catalog.records
    if sections and section_map is not None:
        removed = section_fields(section_map, sections).select(F.col("field").alias("parent")).distinct()
        records = records.join(removed, "parent", "left_anti")
    elif sections:
        records = records.filter(~F.coalesce(F.col("section").isin(*sections), F.lit(False)))
    return _with_records(catalog, records, "feature_pruner")


def prune_breadth(catalog: Catalog, sparsity_threshold: float = 0.25) -> Catalog:
    """Keep records with a null share strictly below the threshold; 0 changes nothing."""
    if not 0.0 <= sparsity_threshold <= 1.0:
        raise ValueError("sparsity_threshold must lie in [0, 1]")
    records = catalog.records
    if sparsity_threshold > 0.0:
        records = records.filter(F.col("sparsity") < F.lit(float(sparsity_threshold)))
    return _with_records(catalog, records, "breadth_pruner")


def prune_leaves(leaves: DataFrame, histogram: DataFrame, coverage: float) -> DataFrame:
    """Leaves whose position is kept at every node above them."""
    keep = node_map(coverage_cutoff(histogram, coverage), "keep")
    joined = leaves.join(keep, "field", "left")
    kept = F.lit(True)
    for position, limit in zip(("layer", "feature", "deposition"), values_on_path()):
        kept = kept & F.coalesce(F.col(position) < limit, F.lit(True))
    return joined.filter(kept).select(*leaves.columns)


def prune_depth(catalog: Catalog, layer_coverage: float = 0.75) -> Catalog:
    """Keep the first children of every node that cover the share of rows; 1 changes nothing."""
    if not 0.0 <= layer_coverage <= 1.0:
        raise ValueError("layer_coverage must lie in [0, 1]")
    leaves = catalog.leaves
    if layer_coverage < 1.0:
        leaves = prune_leaves(leaves, catalog.histogram, layer_coverage)
    return Catalog(catalog.records, catalog.histogram, leaves, (*catalog.history, "depth_pruner"))


PRUNERS = {"feature_pruner": prune_features, "breadth_pruner": prune_breadth, "depth_pruner": prune_depth}


def prune(catalog: Catalog, config: Mapping, **context) -> Catalog:
    """Apply one configured step, or a ``chain_pruner``'s steps in order."""
    method = config.get("method")
    options = {k: v for k, v in config.items() if k != "method"}
    if method == "chain_pruner":
        steps = options.get("steps") or []
        if not steps:
            raise ValueError("a chain needs at least one step")
        for step in steps:
            catalog = prune(catalog, step, **context)
        return catalog
    if method not in PRUNERS:
        raise ValueError(f"unknown pruner {method!r}; known: {sorted(PRUNERS)} and chain_pruner")
    if method == "feature_pruner":
        options = {**options, **context}
    return PRUNERS[method](catalog, **options)


def preprocess_wide(
    df: DataFrame, reference: Sequence[tuple[str, str, str | None]], threshold: float, depth: float,
    sections: Sequence[str], exclude: Sequence[str] = (), keep: Sequence[str] = (),
) -> DataFrame:
    """Whole preprocessing in one call: choose sections, drop sparse and excluded fields,
    decode the layered ones to the given coverage, null tokens, numeric promotion."""
    chosen = [row for row in reference if row[0] in sections]
    dense = set(dense_columns(df, [f for _, f, _ in chosen], threshold))
    chosen = [row for row in chosen if row[1] in dense and row[1] not in exclude]
    catalog = prune_depth(build_catalog(df, chosen), depth)
    wide = normalise_nulls(expand_catalog(df, catalog, keep=keep))
    layered_first = {
        r["Field"]: r["layered"]
        for r in flag_layered(df.sparkSession.createDataFrame(chosen, "section string, Field string, Pattern string")).collect()
    }
    plain = [f for _, f, _ in chosen if not layered_first[f] and f not in keep]
    decoded = [c for c in wide.columns if c not in plain and c not in keep]
    return promote_numeric(wide.select(*keep, *decoded, *plain), columns=[*decoded, *plain])
