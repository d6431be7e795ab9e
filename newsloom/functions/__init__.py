"""Column functions: everything here returns a Column and stays inside the JVM, except the markup helper."""
