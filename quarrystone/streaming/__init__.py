"""streaming of quarrystone."""
