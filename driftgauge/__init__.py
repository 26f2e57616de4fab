"""Mixed-frequency, ragged-edge, revision-prone panels as Spark DataFrames."""

__version__ = "0.1.0"
