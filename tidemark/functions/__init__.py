"""Column functions: all built from Spark's own expressions unless a module says otherwise."""
