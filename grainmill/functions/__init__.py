"""Part of grainmill."""
