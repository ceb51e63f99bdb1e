"""Vellum: curation and evaluation of prose datasets on Spark DataFrames."""

__version__ = "0.1.0"
