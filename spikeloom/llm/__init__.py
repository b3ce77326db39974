"""Training-data operators: deduplication, quality, personal data, mixing, tokens and archives."""
