"""Reusable query shapes that keep large groups out of a single task."""
