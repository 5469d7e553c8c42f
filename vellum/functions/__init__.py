"""Part of the editorial analytics library."""
