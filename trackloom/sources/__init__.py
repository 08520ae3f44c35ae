"""Readers and writers; every schema is explicit, nothing is inferred."""
