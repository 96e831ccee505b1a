"""Event-log analytics as Spark DataFrame programs."""
