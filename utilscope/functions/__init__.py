"""Column functions: text, numbers and formatting. All are built-in expressions."""
