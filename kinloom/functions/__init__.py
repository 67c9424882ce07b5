"""Column functions: normalisation and similarity of texts."""
