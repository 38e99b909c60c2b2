"""Longitudinal cohort analytics as Spark plans.

Every operator takes DataFrames and column names and returns a DataFrame.
"""
