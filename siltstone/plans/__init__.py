"""Queries over whole tables, the derived tables they read, and their SQL for DuckDB."""
