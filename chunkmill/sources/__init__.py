"""Sources of chunkmill."""
