"""Spark-first analytics engine for new-user cohort studies on health records."""
