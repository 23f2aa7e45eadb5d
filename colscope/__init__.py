"""Column usage, documentation gaps and result grading as Spark DataFrame jobs."""
