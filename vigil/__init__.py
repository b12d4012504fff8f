"""vigil: threat-intelligence analytics as Spark DataFrame jobs."""
