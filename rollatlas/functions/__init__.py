"""Column -> Column building blocks. All of them compile to built-in expressions."""
