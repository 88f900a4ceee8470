"""Column builders: geometry, text, vectors, colour."""
