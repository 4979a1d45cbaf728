"""Column expressions and label jobs; all of them stay in the JVM."""
