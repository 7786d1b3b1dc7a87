"""Column-level helpers: null-safe arithmetic, exact statistics, distributed ranking."""
