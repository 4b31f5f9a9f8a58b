"""Composite pipelines: ingest, copy, publish, audit, chain, job board."""
