"""Scalar functions: plain Python kernels and Column expressions."""
