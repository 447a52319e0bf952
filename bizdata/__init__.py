"""Company and contact data jobs on PySpark."""

__version__ = "0.1.0"
