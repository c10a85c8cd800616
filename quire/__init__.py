"""quire: a Spark-first engine for curating libraries of documents and bibliographic records."""

__version__ = "0.1.0"
