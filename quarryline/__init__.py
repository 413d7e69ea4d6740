"""quarryline: Spark-native table profiling, data-quality auditing and split-leakage analysis."""

__version__ = "0.1.0"
