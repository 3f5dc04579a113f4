"""DataFrame operators: validation, summaries, splits, windows, records, fills and comparisons."""
