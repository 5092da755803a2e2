"""Column functions over text, bytes and identifiers."""
