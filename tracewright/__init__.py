"""Mining of repeated behaviour in activity logs, and table analytics, on Spark."""
