"""Training-data operators: text extraction, filtering, deduplication, scoring, mixing and encoding."""
