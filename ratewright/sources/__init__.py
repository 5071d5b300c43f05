"""Reading books of rows and keeping fitted models as Parquet and JSON."""
