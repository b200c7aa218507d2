"""Whole feed preparations; the route plan writes its rows once while it is built."""
