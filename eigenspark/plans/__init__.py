"""Whole analyses, and the queries that the entry module registers."""
