"""Column functions over text, dates and numbers."""
