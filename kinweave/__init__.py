"""Entity matching, record linkage and corpus preparation as lazy Spark plans."""

__version__ = "0.1.0"
