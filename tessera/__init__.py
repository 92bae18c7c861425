"""Tessera: a vector and key-value analytics engine expressed as Spark plans."""

__version__ = "1.1.0"
