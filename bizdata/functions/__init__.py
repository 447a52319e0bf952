"""Column functions.  All are built from Spark's own functions and stay inside the JVM."""
