"""Column expressions of the domain; Arrow UDFs only where Spark has no built-in."""
