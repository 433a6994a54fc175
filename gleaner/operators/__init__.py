"""Operators: column expressions and DataFrame-to-DataFrame steps."""
