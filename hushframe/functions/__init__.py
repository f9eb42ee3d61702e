"""Column expressions: everything here returns a Column and runs inside the JVM."""
