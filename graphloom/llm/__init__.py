"""Training-data pipeline operators: language ID, deduplication, PII, scoring, mixing, packing."""
