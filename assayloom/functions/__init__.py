"""Column expressions. All of them stay inside the JVM unless their docstring says otherwise."""
