"""Column functions: text, numbers, URLs, keys, scores and extraction."""
