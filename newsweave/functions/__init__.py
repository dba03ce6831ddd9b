"""Scalar functions: each takes Columns and returns a Column evaluated in the JVM."""
