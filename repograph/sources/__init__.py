"""Where files, manifests and facts come from."""
