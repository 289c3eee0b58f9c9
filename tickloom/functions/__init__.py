"""Column functions and distributed order statistics shared by the operators."""
