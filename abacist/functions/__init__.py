"""Column expressions shared by batch and streaming code."""
