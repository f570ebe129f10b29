"""Column expressions shared by the operators. All JVM-side, no Python UDFs."""
