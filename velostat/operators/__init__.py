"""DataFrame → DataFrame operators."""

from velostat.operators import features, normalize, profile, quality, routes, stats  # noqa: F401
