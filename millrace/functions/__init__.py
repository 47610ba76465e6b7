"""Part of the millrace engine; see the README for the map of operators."""
