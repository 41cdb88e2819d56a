"""Vibration and acoustics quality analytics on Spark."""
