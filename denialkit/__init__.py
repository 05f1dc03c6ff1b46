"""denialkit: access-control denial analytics as Spark DataFrame plans."""
