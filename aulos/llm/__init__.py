"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this folder; ``__spark_entry__`` adds its queries
only when it is present.
"""
