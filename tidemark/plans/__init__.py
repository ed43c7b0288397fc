"""The feature catalog, column roles, and whole jobs built from operators."""
