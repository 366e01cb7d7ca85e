"""Step loop with bounded lineage, and incremental feeds."""
