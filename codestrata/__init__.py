"""codestrata: analytics over source-repository structure, built on the PySpark DataFrame API."""

__version__ = "0.1.0"
