"""Named plans over the driver tables, grouped by topic."""

from millrace.plans import core, literals, records, relational, run

MODULES = [core, relational, literals, records, run]
