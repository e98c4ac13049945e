"""Column functions: tokenising, clean-up, casing, scoring expressions."""
