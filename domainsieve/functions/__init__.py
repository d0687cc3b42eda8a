"""Column expressions: names, lexical features, scores. Built-in functions only."""
