"""Table migration and reconciliation as Spark DataFrame jobs."""
