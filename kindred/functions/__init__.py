"""Column expressions: vectors, numbers and text. All run in the JVM."""
