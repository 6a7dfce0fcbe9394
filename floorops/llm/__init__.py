"""Training-data operators: sharding, scoring, extraction, de-duplication, packing and search."""
