"""A keyed-table query engine on Spark: a small SQL dialect, an ordered key-value store, and the log, merge and index dataflows under them."""
