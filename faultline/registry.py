"""All registered queries outside the training-data subpackage."""

from .queries import evaluation, files, graphs, learning, sampling, scans, selection  # noqa: F401  importing registers
from .queries.base import ORACLE_SQL, QUERIES  # noqa: F401
