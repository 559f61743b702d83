"""Relational operators over pages, hits, traces, samples and diagrams."""
