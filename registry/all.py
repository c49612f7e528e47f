"""Every registered query with its SQL, where it has one."""

from registry import clusters, labels, sources, topics, vectors, views

_PARTS = (sources, views, topics, vectors, clusters, labels)
QUERIES = {name: fn for part in _PARTS for name, fn in part.Q.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.SQL.items()}
