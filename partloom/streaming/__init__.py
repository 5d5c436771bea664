"""Structured Streaming jobs: page changes, imports, dedup, failures and delta publishing."""
