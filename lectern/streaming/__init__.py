"""Event streams with keyed state."""
