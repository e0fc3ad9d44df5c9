"""Batch operators, one module per subject."""
