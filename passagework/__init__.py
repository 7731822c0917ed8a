"""Document retrieval and corpus-quality engine on Spark."""

__version__ = "0.1.0"
