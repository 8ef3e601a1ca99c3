"""Reading and writing stacks: flat rasters, text tables, exports."""
