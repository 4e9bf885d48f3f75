"""End-to-end chains and the registry of checked queries."""
