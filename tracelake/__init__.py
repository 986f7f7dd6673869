"""Evidence correlation on Spark: artifact tables to facts with entity references, and questions over them."""

__version__ = "0.2.0"
