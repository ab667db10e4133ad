"""Column functions: geometry, zones, quantising and text helpers."""
