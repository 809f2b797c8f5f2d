"""All query registries of the core."""

from tessera.plans import bayes_queries, data_problems, entity_queries, learning_queries, relational_queries, statistics_queries, text_queries

REGISTRIES = [relational_queries.REGISTRY, text_queries.REGISTRY, statistics_queries.REGISTRY, entity_queries.REGISTRY, bayes_queries.REGISTRY, learning_queries.REGISTRY, data_problems.REGISTRY]
