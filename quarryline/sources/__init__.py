"""Readers that turn files into typed DataFrames with a stable row identity."""
