"""tidemark: Spark-native operators for time-coded record libraries and corpus preparation."""

__version__ = "0.1.0"
