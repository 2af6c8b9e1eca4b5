"""Column expressions; every one stays JVM-side."""
