"""Part of the span analytics library."""
