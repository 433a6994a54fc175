"""Jobs over newly arriving page files."""
