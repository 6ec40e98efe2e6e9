"""Membership-interval ("stint") analytics on Spark: who was in which team, when, and with whom."""
