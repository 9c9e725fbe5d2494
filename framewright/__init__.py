"""framewright: ordered-stream, media and text analytics as PySpark DataFrames."""

__version__ = "0.1.0"
