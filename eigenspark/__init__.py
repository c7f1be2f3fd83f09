"""Labelled images and vectors as DataFrames: sampling, projection, classification and model selection."""
