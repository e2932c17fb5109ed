"""tidewrack: relational analysis of shipped JavaScript, and corpus preparation, on PySpark."""

__version__ = "0.1.0"
