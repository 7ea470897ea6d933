"""Part of lineweave."""
