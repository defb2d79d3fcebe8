"""Dependency, change and data-lineage analytics expressed as Spark DataFrame jobs."""
