"""Booking-report reconciliation expressed as Spark DataFrame operators."""
