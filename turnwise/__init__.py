"""Session-log and rule-check analytics as PySpark jobs."""
