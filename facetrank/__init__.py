"""Top-k similarity search over several attributes, written as Spark plans."""

__version__ = "0.1.0"
