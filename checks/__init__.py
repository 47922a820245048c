"""Checks of the registered queries against an independent SQL engine."""
