"""Streams: tagging with three sinks, and clustering with state."""
