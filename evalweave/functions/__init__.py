"""Part of evalweave; see the modules."""
