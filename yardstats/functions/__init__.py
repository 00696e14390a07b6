"""Column expressions and date arithmetic shared by the operators."""
