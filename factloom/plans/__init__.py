"""Plan helpers: cutting lineage through the shared folder, components, size checks."""
