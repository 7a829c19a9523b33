"""Operators for preparing language-model training data, each a Spark job with its own query."""
