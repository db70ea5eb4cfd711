"""Event trains as unbounded streams."""
