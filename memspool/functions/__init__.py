"""Column functions on text, dates and ids."""
