"""skillweave: a Spark-native engine for matching profiles to job posts."""

__version__ = "0.1.0"
