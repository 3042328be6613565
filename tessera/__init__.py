"""Tessera: retrieval and repository analytics as Spark DataFrame pipelines."""
