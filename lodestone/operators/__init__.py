"""Operators over collections: values, scoring, batches of queries, mutation."""
