"""Structured Streaming wrappers around the batch pipelines."""
