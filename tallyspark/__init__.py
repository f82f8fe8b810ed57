"""Zone-level demand analytics as DataFrame operators on Spark."""
