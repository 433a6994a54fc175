"""Reading and writing the interchange files."""
