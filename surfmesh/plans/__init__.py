"""Plans that operators share, and the registered queries."""
