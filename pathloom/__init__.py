"""pathloom: travel-network and trajectory analytics, declared on Spark DataFrames."""

__version__ = "0.1.0"
