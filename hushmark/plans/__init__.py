"""The row-local detection plan."""
