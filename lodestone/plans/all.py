"""All queries and their SQL."""

from lodestone.plans import columns, matching  # noqa: F401
from lodestone.plans.queries import QUERIES, SQL  # noqa: F401
