"""Reading and writing the input and output tables."""
