"""Reading and writing tables and files."""
