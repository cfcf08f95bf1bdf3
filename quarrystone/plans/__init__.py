"""plans of quarrystone."""
