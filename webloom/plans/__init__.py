"""Plan helpers: shared-storage tables that cut lineage, and two-level prefix sums."""
