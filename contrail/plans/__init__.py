"""Rule compiler and the catalogue of registered queries."""
