"""The registered queries, their inputs derived from the given tables, and the SQL to check them with."""
