"""Training-data operators: sharding, extraction, deduplication, filtering, formatting, tokens, language models."""
