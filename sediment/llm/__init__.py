"""Training-data operators: scoring, formatting, deduplication, decontamination, mixing and encoding."""
