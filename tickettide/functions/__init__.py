"""Column functions: everything here maps Columns to a Column and stays in the JVM."""
