"""Sensor-series preparation and forecasting as DataFrame plans."""
