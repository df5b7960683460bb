"""Fathomline: media-file analytics and corpus preparation on Spark DataFrames."""
