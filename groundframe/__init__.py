"""groundframe: analytics over subsurface and construction models as Spark DataFrames."""

__version__ = "0.1.0"
