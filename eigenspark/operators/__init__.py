"""Operators over labelled vectors."""
