"""Column helpers and fixed values shared by the operators."""
