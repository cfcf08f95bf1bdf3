"""Operators of a training-data pipeline. Nothing else in quarrystone imports this subpackage."""
