"""Training-data operators: filtering, licensing, deduplication, packing, mixing and archiving."""
