"""Record-integrity, reconciliation and text analytics as Spark DataFrame jobs."""
