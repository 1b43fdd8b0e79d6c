"""Column expressions: text with Python's notion of blanks and lines, Markdown, names, hashes."""
