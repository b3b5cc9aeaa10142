"""Column functions: text, ids, percentiles, probabilities, alignment."""
