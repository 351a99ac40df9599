"""Event-time window analytics and fleet-table analytics as PySpark DataFrame functions."""
