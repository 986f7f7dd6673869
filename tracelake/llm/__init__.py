"""Operators for preparing training corpora, each a Spark job over a documents table."""
