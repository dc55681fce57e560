"""lodestrata: a Spark-first analytics engine for code-and-evidence corpora."""

__version__ = "0.1.0"
