"""Column functions and batch scorers."""
