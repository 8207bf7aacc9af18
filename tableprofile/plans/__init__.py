"""Reports and prompt tables composed of several operators."""
