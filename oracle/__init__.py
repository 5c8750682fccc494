"""Independent SQL for another engine: what every registered query must return."""
