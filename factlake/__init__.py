"""factlake: build and query a knowledge graph on Spark."""

__version__ = "0.1.0"
