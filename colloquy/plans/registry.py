"""Every query of the core by name with its SQL; the text operators register themselves in their own subpackage."""

from __future__ import annotations

from colloquy.operators import timestamps
from colloquy.plans import base, facets, functions, ingest, listing, search, streams  # noqa: F401  they register their queries
from colloquy.sources import lines

QUERIES = {"p4_found": timestamps.found, "p4_instants": timestamps.instants, "p5_found": lines.found, "p5_parse_issues": lines.parse_issues, "p5_loaded": lines.loaded} | base.QUERIES
SQL = base.SQL
