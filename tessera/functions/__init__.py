"""Types, index arithmetic and byte planes as column expressions."""
