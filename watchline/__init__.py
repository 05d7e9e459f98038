"""watchline: security-event analytics on Spark DataFrames and streams."""

__version__ = "0.1.0"
