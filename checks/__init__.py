"""Registered checks: the given tables bound to the data model, Spark queries and their SQL."""
