"""Spark-first analytics over long ordered recordings and the catalogues built from them."""
