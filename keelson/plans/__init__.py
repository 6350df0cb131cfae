"""Query registry (metrics bound to tables and parameters) and SQL oracles."""
