"""Landscapes, metrics and registered queries."""
