"""A Spark-first engine for emergency-station analytics."""
