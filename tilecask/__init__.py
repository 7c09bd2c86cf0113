"""Part of the tilecask engine."""
