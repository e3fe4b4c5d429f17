"""Empty: the blueprint has no stream operators (all tables are bounded)."""
