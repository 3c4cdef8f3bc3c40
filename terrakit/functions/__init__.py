"""Column builders. Everything here returns Catalyst expressions."""
