"""Reading and writing SQL text."""
