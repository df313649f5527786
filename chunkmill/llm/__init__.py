"""Training-data operators: tokenizing, scoring, de-duplication, packing and search."""
