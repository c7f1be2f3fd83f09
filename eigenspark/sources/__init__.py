"""Readers of images, and writers of results."""
