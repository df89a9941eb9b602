"""Event-listing consolidation and corpus preparation as Spark jobs."""
