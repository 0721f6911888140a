"""Readers and writers of incidents, panels, forecasts and resolutions."""
