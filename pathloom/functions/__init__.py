"""Column functions: everything here takes and gives Columns and stays in the JVM, unless its name says pandas."""
