"""Column functions: decoding of score paths, text metrics, charsets."""
