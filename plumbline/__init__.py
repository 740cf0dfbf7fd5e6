"""Plumbline: a Spark-first library for building and auditing client-suitability datasets."""
