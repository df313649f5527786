"""Table operators of chunkmill."""
