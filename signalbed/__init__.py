"""Log, metric and trace analytics as plain Spark transforms."""
