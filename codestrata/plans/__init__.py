"""Named queries with their SQL oracles, and multi-step programs."""
