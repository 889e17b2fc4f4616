"""Column functions: formats, fingerprints, byte decoding and null-aware truth."""
