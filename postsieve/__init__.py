"""postsieve: a Spark-native engine that curates postings collected from many feeds."""

__version__ = "0.1.0"
