"""Structured Streaming pipelines, panes and sinks."""
