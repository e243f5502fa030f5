"""Coupon campaign measurement as Spark jobs."""
