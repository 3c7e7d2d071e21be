"""Column expressions shared by the operators. All of them are native Spark expressions."""
