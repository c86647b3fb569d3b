"""Every registered query of the reference's operators, with the SQL that checks it."""

from __future__ import annotations

from foliograph.plans import citations, details, glyphs, layout, links, marks, outlines, places, text

MODULES = (layout, text, citations, places, marks, glyphs, outlines, links, details)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
