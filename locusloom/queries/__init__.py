"""All registered queries of the library."""

from ..registry import FLAGSHIP, ORACLE_SQL, QUERIES
from . import areas, assembly, clean, compare, hits, joins, peptides, predict, reports, scans, sites

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "areas", "assembly", "clean", "compare", "hits", "joins", "peptides", "predict", "reports", "scans", "sites"]
