"""millrace: corpus curation, controlled sampling and graded-result analytics on PySpark."""

__version__ = "0.1.0"
