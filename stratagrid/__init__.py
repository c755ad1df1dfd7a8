"""Analytics over raster cubes, point samples and administrative tables on Spark DataFrames."""

__version__ = "0.1.0"
