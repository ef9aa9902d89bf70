"""Corpus analytics for speech and text datasets on Spark DataFrames."""
