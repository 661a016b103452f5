"""Operators over pages, lines and tiles: pixel kernels in numpy, everything one-dimensional as DataFrame expressions."""
