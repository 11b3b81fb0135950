"""Settlement matching and double-entry ledger analytics as Spark jobs."""

__version__ = "0.1.0"
