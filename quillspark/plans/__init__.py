"""Named queries composed of the operators."""
