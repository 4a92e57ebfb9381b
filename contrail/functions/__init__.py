"""Column functions: geometry, identifiers, weather, time, tiles."""
