"""Column expressions: geometry of segments, planes, cameras; distances of embeddings; paths."""
