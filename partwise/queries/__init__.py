"""Named queries of the core with their SQL twins."""
