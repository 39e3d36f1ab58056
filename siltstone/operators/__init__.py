"""DataFrame operators: extraction, screening, sampling, comparison, validation, residues, storage."""
