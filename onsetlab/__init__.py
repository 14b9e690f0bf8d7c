"""Event-locked pattern decoding as Spark jobs."""
