"""Tideline: coastal-change analytics expressed as Spark jobs."""
