"""Imports every query module so that all queries are registered."""

from txrisk.plans import queries  # noqa: F401
from txrisk.plans import queries_data  # noqa: F401
from txrisk.plans import queries_eval  # noqa: F401
from txrisk.plans import queries_ml  # noqa: F401
from txrisk.plans import queries_stream  # noqa: F401
from txrisk.plans.queries import flagship  # noqa: F401
