"""streaming of rootflow."""
