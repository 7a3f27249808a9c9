"""Structured Streaming: sources, stateful operators, per-batch jobs."""
