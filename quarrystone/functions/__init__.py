"""functions of quarrystone."""
