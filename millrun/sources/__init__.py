"""Inputs: the plant registry, historian and alarm-log readers, test fixtures."""
