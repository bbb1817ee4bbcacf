"""Column-level scalars: time arithmetic, predicates, tariff buckets."""
