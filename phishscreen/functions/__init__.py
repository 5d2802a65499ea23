"""Part of phishscreen."""
