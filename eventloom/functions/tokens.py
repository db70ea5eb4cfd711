"""Feature-space tokens ``<family>[_S<order> or _C<order>][_D<lag><dims>]``, the suffixes in either order, as columns.

A token that isn't of this form (another letter, no number, a suffix twice, a lag of 0 alone) is a family of its own.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = r"^(.*?)(?:_[SC][0-9]+(?:_D[0-9][0-9])?|_D[1-9][0-9]|_D[0-9][0-9]_[SC][0-9]+)$"
SPATIAL, LAG = r"_([SC])([0-9]+)(?:_D[0-9][0-9])?$", r"_D([0-9])([0-9])(?:_[SC][0-9]+)?$"


def formed(token: Column) -> Column:
    return token.rlike(SUFFIXES) & ~F.regexp_extract(token, SUFFIXES, 1).rlike(r"_.[0-9]+$")


def part(token: Column, pattern: str, group: int) -> Column:
    return F.when(formed(token), F.nullif(F.regexp_extract(token, pattern, group), F.lit("")))


def family(token: Column) -> Column:
    return F.when(formed(token), F.regexp_extract(token, SUFFIXES, 1)).otherwise(token)


def is_derivative(token: Column) -> Column:
    return family(token) == "stderiv"


def spatial(token: Column) -> Column:
    return part(token, SPATIAL, 1)


def spatial_order(token: Column) -> Column:
    return part(token, SPATIAL, 2).cast("int")


def lag(token: Column) -> Column:
    return part(token, LAG, 1).cast("int")


def dims(token: Column) -> Column:
    return part(token, LAG, 2).cast("int")
