"""sources of quarrystone."""
