"""Storage-inventory analytics as DataFrame-to-DataFrame functions."""
