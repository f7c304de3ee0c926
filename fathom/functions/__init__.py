"""Scalar functions with MySQL's meaning, as Column expressions."""
