"""Structured Streaming pipelines: claims, tallies, digests, alerts."""
