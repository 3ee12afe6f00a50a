"""Frontends: source text to one nested record per file."""

from loomgraph.sources.frontends.record import SCHEMA, extract_text

__all__ = ["SCHEMA", "extract_text"]
