"""braidwork: a Spark-native engine for overlap graphs and corpus preparation."""

__version__ = "0.1.0"
