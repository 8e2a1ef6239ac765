"""Predicates of lists, composable with &."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import SHORTAGE
from quarry.functions.text import normalize

#: Public names of filters and the labels they stand for.
AUTHORISATION = {"active": "Autorisation active", "abrogee": "Autorisation abrogée", "archivee": "Autorisation archivée", "retiree": "Autorisation retirée", "suspendue": "Autorisation suspendue"}
#: As above; homeo and phyto are mapped to the labels that the data really have.
PROCEDURE = {
    "nationale": ("Procédure nationale",),
    "centralisee": ("Procédure centralisée",),
    "decentralisee": ("Procédure décentralisée",),
    "reconnaissance_mutuelle": ("Procédure de reconnaissance mutuelle",),
    "homeo": ("Enreg homéo (Proc. Nat.)",),
    "phyto": ("Enreg phyto (Proc. Nat.)", "Enreg phyto (Proc. Dec.)"),
    "importation_parallele": ("Autorisation d'importation parallèle",),
}
#: Public names of roles in a group.
ROLE = {"princeps": 0, "generique": 1, "complementarite": 2, "substituable": 4}
#: Public names of shortage states.
SHORTAGE_FILTER = {"rupture": 1, "tension": 2, "arret": 3, "remise_disposition": 4}


def equals_flag(c: Column, label: str, wanted: bool | None) -> Column:
    """(c = label) = wanted; everything if nothing is wanted."""
    return F.lit(True) if wanted is None else (c == label) == F.lit(wanted)


def equals_ignoring_case(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()


def any_equals(c: Column, value: str) -> Column:
    return F.exists(c, lambda x: F.lower(x) == value.lower())


def norm_contains(c: Column, value: str) -> Column:
    """The normalised text holds the normalised value; a value that normalises to nothing holds always."""
    part = normalize(F.lit(value))
    return (part == "") | F.contains(normalize(c), part)


def any_norm_contains(c: Column, value: str) -> Column:
    part = normalize(F.lit(value))
    return (part == "") | F.exists(c, lambda x: F.contains(normalize(x), part))


def code_or_name(code: Column, name: Column, value: str) -> Column:
    return (code == value) | norm_contains(name, value)


def shortages(df: DataFrame, state: str | None = None, key: Column | None = None, since: str | None = None, active: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """Shortage list: state by public name, parent, updated since, and by default only those not over; newest first, then by ``ties``."""
    out = df
    if state is not None:
        if state not in SHORTAGE_FILTER or SHORTAGE_FILTER[state] not in SHORTAGE:
            raise ValueError(f"unknown state {state}")
        out = out.where(F.col("code_statut") == SHORTAGE_FILTER[state])
    if key is not None:
        out = out.where(key)
    if since is not None:
        out = out.where(F.col("date_mise_a_jour") >= F.lit(since).cast("date"))
    if active:
        out = out.where("date_remise_disposition is null")
    return out.orderBy(F.col("date_mise_a_jour").desc_nulls_last(), *ties)
