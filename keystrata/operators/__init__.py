"""Dataflows over versioned rows: merging, compaction, statistics, log replay and membership."""
