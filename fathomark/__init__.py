"""fathomark: search, link-graph, quality and training-data operators over note corpora, as Spark plans."""

__version__ = "0.1.0"
