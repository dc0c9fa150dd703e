"""sources of rootflow."""
