"""The registered queries with the SQL that checks them."""

from contract import learning, relational, reports, stored, streams, texts  # noqa: F401
from contract.views import REGISTRY, Tables  # noqa: F401
