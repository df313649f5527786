"""chunkmill: Spark jobs that recover media from many browser HTTP caches at once."""
