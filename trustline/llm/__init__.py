"""Training-data operators: classification, deduplication, tokens, sharding and packing."""
