"""Column functions: text, geography and statistics."""
