"""functions of rootflow."""
