"""Seat-allocation analytics expressed as Spark DataFrame plans."""
