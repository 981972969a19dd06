"""Operators over record streams: classify, profile, register, retrieve, compare, consolidate, evaluate."""
