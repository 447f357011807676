"""Column functions: text, scores, sentiment and rules."""
