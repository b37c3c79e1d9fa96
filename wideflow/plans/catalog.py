"""All registered queries and their DuckDB oracles, merged from the plan modules."""

from __future__ import annotations

import importlib

_MODULES = [
    "wideflow.plans.q_evaluate",
    "wideflow.plans.q_clean",
    "wideflow.plans.q_impute",
    "wideflow.plans.q_models",
    "wideflow.plans.q_select",
    "wideflow.plans.q_explain",
    "wideflow.plans.q_threshold",
    "wideflow.plans.q_sinks",
]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        m = importlib.import_module(name)
        dup = set(queries) & set(m.Q)
        if dup:
            raise ValueError(f"duplicate query names: {dup}")
        queries.update(m.Q)
        oracle.update(m.SQL)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    q, o = _load()
    return {k: v for k, v in o.items() if k in q and v}
