"""Column expressions: binning, links, losses and deviances."""
