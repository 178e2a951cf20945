from flowfeat.operators import (
    features,
    ids,
    metrics,
    models,
    positions,
    recommend,
    sampling,
    sequence,
    series,
    text,
)

__all__ = [
    "features",
    "ids",
    "metrics",
    "models",
    "positions",
    "recommend",
    "sampling",
    "sequence",
    "series",
    "text",
]
