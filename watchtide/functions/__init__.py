"""Column functions: symbols, numbers, times, keys, severities, texts, risk."""
