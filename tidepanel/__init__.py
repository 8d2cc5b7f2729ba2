"""Panel time-series analytics as lazy Spark DataFrame operators.

A panel is a long DataFrame keyed by ``(entity_id, t)`` with a ``t`` that counts
fixed-size periods and one or more value columns (``amount`` by default).
"""

__version__ = "0.1.0"
