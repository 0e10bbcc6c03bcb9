"""Plan helpers: shared storage that cuts lineage, and table loading."""
