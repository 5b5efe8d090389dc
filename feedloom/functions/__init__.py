"""Column expressions: hashes, URLs, times, arrays and retry delays."""
