"""All queries of the core library and their SQL."""

from siltstone.plans import analysis, extraction

QUERIES = extraction.QUERIES | analysis.QUERIES
ORACLES = extraction.ORACLES | analysis.ORACLES
