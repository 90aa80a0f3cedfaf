"""Spark jobs for employer-sponsorship and job-market data."""
