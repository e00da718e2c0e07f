"""quillbar: Spark-native analytics for time-series judgement records."""

__version__ = "0.1.0"
