"""End-to-end study flows and the registered queries."""


def load():
    """Import every query module and return (queries, oracle SQL)."""
    from importlib import import_module

    from studyframe.plans.registry import ORACLE, QUERIES

    for name in MODULES:
        import_module(f"studyframe.plans.{name}")
    return QUERIES, ORACLE


MODULES = ["q_metrics", "q_rank", "q_schema", "q_quality", "q_stats", "q_split", "q_models", "q_reports"]
