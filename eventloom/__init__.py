"""eventloom: event-train and time-series state analytics on Spark DataFrames."""

__version__ = "0.1.0"
