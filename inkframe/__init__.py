"""inkframe: DataFrame-first analytics for recognised-text and page-layout data on Apache Spark."""

__version__ = "0.1.0"
