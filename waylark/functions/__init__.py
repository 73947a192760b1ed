"""Column-level functions. Everything here builds JVM-side expressions."""
