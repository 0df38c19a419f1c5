"""Column functions: text in, spans, tokens and votes out."""
