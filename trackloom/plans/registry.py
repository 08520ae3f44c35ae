"""All queries over the driver's tables, by name, and their SQL."""

from . import feed, library, machines, more, motion, stored  # noqa: F401
from .roles import ORACLE_SQL, QUERIES  # noqa: F401
