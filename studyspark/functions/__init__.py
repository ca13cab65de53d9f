"""Column expressions; everything runs inside the JVM unless a function says otherwise."""
