"""Column expressions: text, numbers, dates, traffic measures, map projection."""
