"""Fuel telemetry analytics for equipment fleets, as lazy DataFrame functions."""
