"""Susceptibility analytics on PySpark: every operator is a DataFrame -> DataFrame function."""
