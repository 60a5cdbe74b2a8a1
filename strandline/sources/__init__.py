"""Readers and writers of the usual text formats, on Spark's own text, csv and xml sources.

Readers take any path that Spark reads and give DataFrames; records that span lines are
cut by Spark's line separator, so files stay splittable.
"""
