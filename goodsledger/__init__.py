"""Purchase-to-receipt reconciliation and supplier analytics as Spark DataFrame jobs."""
