"""chunkmill: document corpora to chunk stores and training samples, on Spark DataFrames."""

__version__ = "0.1.0"
