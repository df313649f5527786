"""Jobs and queries of chunkmill."""
