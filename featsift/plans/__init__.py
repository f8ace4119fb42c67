"""Query catalog (Spark plans + DuckDB oracle SQL) and the end-to-end pipelines."""
