"""Query catalog (Spark side), SQL oracles (DuckDB side) and plan helpers."""
