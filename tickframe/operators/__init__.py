"""Part of the market event engine."""
