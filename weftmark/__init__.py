"""weftmark: captured web pages to clean, model-ready markdown on Spark."""

__version__ = "0.1.0"
