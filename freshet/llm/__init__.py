"""Operators for large training-data pipelines: mergeable sketches and text operators. Nothing outside this folder imports it."""
