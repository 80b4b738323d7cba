"""Colony counting from measured regions to condition rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import assay


@dataclass(frozen=True)
class Colonies:
    regions: DataFrame
    plate: DataFrame
    condition: DataFrame


def colonies(regions: DataFrame, min_diameter_um: float, min_solidity: float, confluent_at: float = 0.55) -> Colonies:
    """regions: condition, plate, area_px, solidity, touches_border, um_per_px, stained_fraction."""
    gated = assay.colony_gate(regions, min_diameter_um, min_solidity)
    plate = assay.colony_plates(gated, confluent_at)
    return Colonies(gated, plate, assay.colony_conditions(plate))
