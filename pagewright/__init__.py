"""Page-quality analytics on Spark: DataFrame functions for web pages, search results and text corpora."""

__version__ = "0.1.0"
