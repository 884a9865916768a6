"""Names of the training-data queries and their SQL."""

from __future__ import annotations

from gleaner.llm import canonical, clusters, leaks, merge_groups, mixing, neighbours, splits, subset, truncation

QUERIES = {
    "p2_found": clusters.p2_found,
    "p2_clusters": clusters.p2_clusters,
    "p3_found": splits.p3_found,
    "p3_splits": splits.p3_splits,
    "p4_found": neighbours.p4_found,
    "p5_subset": subset.p5_subset,
    "p6_found": canonical.p6_found,
    "p7_found": merge_groups.p7_found,
    "p8_found": leaks.p8_found,
    "p8_items": leaks.p8_items,
    "p8_removed": leaks.p8_removed,
    "p9_found": mixing.p9_found,
    "p9_mix": mixing.p9_mix,
    "p9_shares": mixing.p9_shares,
    "p10_found": truncation.p10_found,
    "p10_sources": truncation.p10_sources,
}
ORACLES = {"p3_found": splits.P3_FOUND_SQL, "p3_splits": splits.P3_SPLITS_SQL, "p7_found": merge_groups.P7_FOUND_SQL}
