"""Lares: residential property-market analytics as Spark DataFrame jobs."""
