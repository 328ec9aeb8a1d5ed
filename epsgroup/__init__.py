"""Grouping of tables whose rows carry a numeric vector, as Spark jobs."""
