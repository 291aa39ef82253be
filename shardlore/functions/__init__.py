"""Element types, scalar functions and codecs."""
