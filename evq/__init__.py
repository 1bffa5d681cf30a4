"""evq: correlation of security and audit telemetry on PySpark DataFrames."""

__version__ = "0.1.0"
