"""Frame streams: synchronised topics, first frames, frame counters, histograms. Watermarks are this engine's own."""
