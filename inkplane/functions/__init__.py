"""Column builders: scalar and array expressions that stay inside the JVM."""
