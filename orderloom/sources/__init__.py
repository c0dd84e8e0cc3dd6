"""Readers, writers and the adapter that derives an order feed from the driver's tables."""
