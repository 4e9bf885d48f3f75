"""Column functions: Column in, Column out, evaluated by Spark itself."""
