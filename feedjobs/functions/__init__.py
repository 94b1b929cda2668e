"""Column functions: text, dates, URLs."""
