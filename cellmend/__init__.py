"""cellmend: a Spark-native engine for budget-aware tabular data repair analytics."""

__version__ = "0.1.0"
