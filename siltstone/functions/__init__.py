"""Column functions: matches with offsets, units, names and hashes."""
