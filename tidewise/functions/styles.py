"""Class labels of floods and roads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewise.functions.rain import rain_risk


def flood_class(var: Column) -> Column:
    return F.when(var <= 0, "none").when(var == 1, "yellow").when(var == 2, "orange").when(var == 3, "red").otherwise("grey")


def road_class(static: Column, intensity: Column, rain_only: bool = False) -> Column:
    """Colour of the higher of static and rain risk; blue shades where rain is the higher one.

    With ``rain_only`` rain alone decides, and is deepest above 30.
    """
    rain = rain_risk(intensity)
    if rain_only:
        return F.when(intensity > 30, "deep-purple").when(rain == 2, "blue").when(rain == 1, "light-blue").otherwise("grey")
    both = F.greatest(static, rain.cast("double"))
    own = F.when(both == 1, "yellow").when(both == 2, "orange").when(both == 3, "red").otherwise("grey")
    return F.when((rain > static) & (rain == 1), "light-blue").when((rain > static) & (rain == 2), "dark-blue").when((rain > static) & (rain == 3), "deep-purple").otherwise(own)


def road_class_static(risk: Column) -> Column:
    return F.when(risk == 0, "grey").when(risk == 1, "yellow").when(risk == 2, "orange").when(risk == 3, "red").otherwise("white")
