"""Column functions with the exact text and number rules of the library."""
