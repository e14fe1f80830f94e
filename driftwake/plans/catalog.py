"""The query registry: names, Spark plans and oracle SQL."""

from __future__ import annotations

from driftwake.plans import (
    fixtures,
    oracles_attribution,
    oracles_evidence,
    oracles_quality,
    oracles_raster,
    oracles_scene,
    oracles_vessel,
    queries_attribution,
    queries_evidence,
    queries_quality,
    queries_raster,
    queries_scene,
    queries_vessel,
)

FLAGSHIP = "posterior_rank"
_PLANS = (queries_vessel.QUERIES, queries_attribution.QUERIES, queries_quality.QUERIES,
          queries_raster.QUERIES, queries_scene.QUERIES, queries_evidence.QUERIES)
_ORACLES = (oracles_vessel.ORACLES, oracles_attribution.ORACLES, oracles_quality.ORACLES,
            oracles_raster.ORACLES, oracles_scene.ORACLES, oracles_evidence.ORACLES)


def queries() -> dict:
    return {k: v for group in _PLANS for k, v in group.items()}


def oracle_sql() -> dict[str, str]:
    return {k: fixtures.with_views(v) for group in _ORACLES for k, v in group.items()}
