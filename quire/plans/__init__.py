"""Query plans: the registry that the entry module exposes."""
