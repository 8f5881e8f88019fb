"""Trussline: drawing and building-model analytics, written as Spark DataFrame jobs."""
