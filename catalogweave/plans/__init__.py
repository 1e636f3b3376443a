"""User-level jobs, each composed of operators."""
