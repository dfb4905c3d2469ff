"""Compositions of the operators (the reference's end-to-end preparation flows)."""
