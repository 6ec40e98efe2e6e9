"""Composite queries a user calls: team page, player page, main report, refresh."""
