"""All registered queries and their SQL."""


def load():
    from clipgraph.registry import core
    from clipgraph.registry import decisions, embeddings, graphs, models, scoring, signals, streams  # noqa: F401

    return core.QUERIES, core.SQL
