"""Plans of steps."""
