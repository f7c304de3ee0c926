"""Readers and writers: Parquet tables, external formats, JSON with a dead-letter side, and layouts."""
