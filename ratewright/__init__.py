"""Rating-table models on Spark: binning, encoding, boosting, tables, scoring and review."""
