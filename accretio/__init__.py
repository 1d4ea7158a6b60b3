"""accretio: append-only observation logs, folds and read surfaces on PySpark."""

__version__ = "0.1.0"
