"""DataFrame operators: binning, encoding, aggregation, ranking, tables and review."""
