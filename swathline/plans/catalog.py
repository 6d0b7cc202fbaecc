"""Every query by name, with the SQL that says the same where SQL can."""

from __future__ import annotations

from . import documents, geometry, planner, replays, scalars, sequences, sessions, shapes
from .spec import ORACLE, QUERIES

scalars.register()
geometry.register()
sequences.register()
planner.register()
shapes.register()
replays.register()
documents.register()
sessions.register()

__all__ = ["ORACLE", "QUERIES"]
