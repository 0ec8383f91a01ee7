"""Part of the speech analytics engine."""
