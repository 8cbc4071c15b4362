"""Column functions and numpy kernels of single values."""
