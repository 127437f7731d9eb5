"""Column expressions shared by the operators. All are JVM built-ins; there are no UDFs."""
