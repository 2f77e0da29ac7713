"""Satellite-navigation network analytics and training-data operators on Spark DataFrames."""
