"""Part of codestrata."""
