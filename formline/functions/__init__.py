"""Functions: strict JSON parsing, shapes, identities, and column expressions over them."""
