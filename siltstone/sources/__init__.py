"""Readers and writers of the file formats and services the records come from."""
