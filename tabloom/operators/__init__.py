"""DataFrame operators: metrics, profiles, cleaning, browsing and catalog merges."""
