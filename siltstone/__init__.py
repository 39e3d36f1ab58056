"""Evidence analytics on Spark: extraction, checking, sampling, comparison and storage of text evidence."""
