"""operators of rootflow."""
