"""Column expressions: text, vectors, scores and chunking."""
