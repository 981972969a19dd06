"""formline: schema discovery and analytics over record streams, declared as Spark plans."""

__version__ = "0.1.0"
