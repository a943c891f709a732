"""Time-decayed retrieval, ordered decision streams and trace analytics as Spark programs."""
