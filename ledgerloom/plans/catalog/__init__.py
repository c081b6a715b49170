"""Every registered query with its oracle text."""

from ledgerloom.plans.catalog import cleaning, expansion, forecasting, models, scoring, segments

_PARTS = (cleaning, segments, scoring, forecasting, expansion, models)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
