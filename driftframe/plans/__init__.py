"""Queries over the tables of a data folder, each with its SQL where SQL can say it."""


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from driftframe.plans import navigation, registry, replay_queries, report_queries, road_queries, stream_queries, time_queries, window_queries

    assert all((navigation, replay_queries, report_queries, road_queries, stream_queries, time_queries, window_queries))
    return registry.QUERIES, registry.ORACLE_SQL
