"""Plan-level building blocks: lineage cuts, skew handling, distributed ranking, contracts."""
