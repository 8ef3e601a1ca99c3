"""Displacement-stack analytics on PySpark DataFrames."""
