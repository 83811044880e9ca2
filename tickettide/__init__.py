"""Ticket snapshots, trends and SLA figures as Spark DataFrame code."""
