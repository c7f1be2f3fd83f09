"""Scoring of images as they arrive."""
