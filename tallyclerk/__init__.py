"""Document reconciliation on Spark: classify, extract, compare, escalate, score."""
