"""Colours of waypoints and components."""

from __future__ import annotations

# Fixed palette: red, green and blue of ten colours, used in turn.
PALETTE = (
    (0.90, 0.22, 0.18),
    (0.98, 0.52, 0.12),
    (0.95, 0.82, 0.15),
    (0.55, 0.88, 0.22),
    (0.18, 0.78, 0.42),
    (0.16, 0.72, 0.82),
    (0.22, 0.42, 0.95),
    (0.52, 0.28, 0.92),
    (0.88, 0.22, 0.72),
    (0.82, 0.38, 0.55),
)


def channel(i: str, k: int, factor: str = "1e0") -> str:
    """Channel ``k`` of the i-th colour, times a brightness, at most one."""
    cases = " ".join(f"WHEN {n} THEN {c[k]}e0" for n, c in enumerate(PALETTE))
    return f"least(1e0, ({factor}) * (CASE ({i}) % {len(PALETTE)} {cases} END))"


def rgba_text(i: str, alpha: str) -> str:
    cases = " ".join(f"WHEN {n} THEN '{c[0]:.4f} {c[1]:.4f} {c[2]:.4f} {alpha}'" for n, c in enumerate(PALETTE))
    return f"(CASE ({i}) % {len(PALETTE)} {cases} END)"


def hue(i: str, step: int, start: int = 0) -> str:
    """Hue in degrees of the i-th component."""
    return f"(({step} * ({i}) + {start}) % 360)"
