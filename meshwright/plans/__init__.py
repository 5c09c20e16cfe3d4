"""Registries and composite plans, and the registered queries."""
