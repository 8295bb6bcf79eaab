"""All registered queries."""

from lectern.plans import attribution, citations, filters, imports, languages, library, listing, ordering, relations, retrieval, statistics, streams, texts
from lectern.plans.registry import ORACLES, QUERIES
