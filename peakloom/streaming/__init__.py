"""Peak queries over streams."""
