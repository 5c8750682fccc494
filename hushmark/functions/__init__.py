"""Row-local Spark SQL expressions: text in, text out, no Python worker."""
