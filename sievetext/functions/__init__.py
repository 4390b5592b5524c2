"""Column functions: text clean-up, bit vectors, encoders."""
