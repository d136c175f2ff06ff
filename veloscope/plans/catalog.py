"""All registered queries: name → (Spark plan, DuckDB oracle SQL or None)."""

from __future__ import annotations

from functools import lru_cache

from veloscope.plans.common import Query


@lru_cache(maxsize=1)
def all_queries() -> dict[str, Query]:
    from veloscope.plans import (coverage_queries, drift_queries, eval_queries, extra_queries, feature_queries, ml_queries,
                                 model_queries, model_scoring_queries,
                                 quality_queries,
                                 scoring_queries, store_queries, stream_queries)
    from veloscope.plans.flagship import FLAGSHIP_SQL, flagship

    out: dict[str, Query] = {
        "flagship_user_velocity_risk": Query("flagship_user_velocity_risk", flagship, FLAGSHIP_SQL,
                                             "per-user velocity risk report"),
    }
    for mod in (feature_queries, quality_queries, scoring_queries, eval_queries, drift_queries, model_queries,
                store_queries, stream_queries, ml_queries, extra_queries, model_scoring_queries,
                coverage_queries):
        for name, q in mod.build().items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = q
    return out
