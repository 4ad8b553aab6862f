"""Operators on training text: mixing, duplicates, scores, spans, packing."""
