"""The registered queries: every operator run on the standard test tables.

``queries()`` and ``oracles()`` hold the Spark side and, where SQL can express
it, an independent SQL form over the same tables.
"""

from __future__ import annotations

from moraine.workload import (  # noqa: F401  (importing registers the queries)
    audits, changes, checks, diffs, inventories, joins, measures, phases, streams, types,
)
from moraine.workload.registry import oracles, queries  # noqa: F401
