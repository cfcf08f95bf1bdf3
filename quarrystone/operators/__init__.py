"""operators of quarrystone."""
