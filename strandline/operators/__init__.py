"""Operators by area: reads, intervals, hits, variants, statistics, mappings, annotation, maps."""
