"""Recipes from EPUB cookbooks and a store to query them, on Spark DataFrames."""

__version__ = "0.1.0"
