"""labelkit: build, score and check labelled datasets on Spark DataFrames."""

__version__ = "0.1.0"
