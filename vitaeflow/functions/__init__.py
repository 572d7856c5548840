"""Column functions. All are built from engine expressions, so plans stay in the JVM."""
