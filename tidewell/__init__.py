"""A Spark-first engine for tracking organisations and their published openings."""
