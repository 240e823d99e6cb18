"""Column functions: text, time, and the few that need Python (Arrow-batched)."""
