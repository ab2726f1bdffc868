"""Training-data operators: fingerprints, token files, extraction, quality, scoring, privacy, packing, duplicates, leaks, archives."""
