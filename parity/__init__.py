"""Independent SQL for every registered query, run by another engine."""
