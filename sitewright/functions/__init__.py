"""Column functions: URL handling, classification and markup extraction."""
