"""The loaded tables as a catalogue: record views, look-ups, lists and sub-resources.

Everything is a DataFrame over whole tables; a look-up takes a table of asked
keys, so one job answers as many requests as there are.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import params
from quarry.functions.scalars import GENERIC_VIEW, lookup, rates
from quarry.functions.text import normalize
from quarry.operators import filters, paging, relations, search
from quarry.sources.shared import near

#: Names of the optional sections of a full record.
SECTIONS = ("presentations", "composition", "generiques", "avis", "conditions", "ruptures")
#: Names of sort orders.
SORTS = ("pertinence", "denomination", "date_amm")
#: Paths of resources.
DRUGS, SUBSTANCES = "/v1/medicaments/", "/v1/substances/"


@dataclass(frozen=True)
class Catalogue:
    """Tables as a load publishes them; ``row_no`` is a row's place in its file."""

    specialites: DataFrame
    presentations: DataFrame
    composants: DataFrame
    avis_smr: DataFrame
    avis_asmr: DataFrame
    substances: DataFrame
    groupes_generiques: DataFrame
    conditions: DataFrame
    ruptures: DataFrame
    mitm: DataFrame

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Catalogue:
        return cls(**{name: tables[name] for name in cls.__dataclass_fields__})


def _day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _text(name: str) -> Column:
    """An empty text is absent."""
    return F.nullif(F.col(name), F.lit("")).alias(name)


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)


def bare_code(c: Column) -> Column:
    """A code without leading zeros; zero and codes that are no number are empty."""
    return F.when(c.rlike(r"\A[0-9]+\z"), F.regexp_replace(c, r"\A0+", "")).otherwise("")


# Views


def pack_view(packs: DataFrame) -> DataFrame:
    """Packs; prices stay null where there is none."""
    return packs.select(
        "cis", "row_no", "cip13", "cip7", "libelle", "statut_administratif", "etat_commercialisation", _day("date_declaration"), "agrement_collectivites",
        F.coalesce(rates(F.col("taux_remboursement")), F.array().cast("array<int>")).alias("taux_remboursement"),
        "prix_medicament_cents", "prix_public_cents", F.col("honoraires_cents").alias("honoraires_dispensation_cents"), _text("indications_remboursement"),
    )


def parent_ref(rows: DataFrame, drugs: DataFrame, name: str = "medicament") -> DataFrame:
    """``rows`` with their drug: code, name and path; rows of unknown drugs are dropped."""
    parents = drugs.select("cis", F.struct("cis", "denomination", F.concat(F.lit(DRUGS), "cis").alias("_link")).alias(name))
    return rows.join(parents, "cis")


def ingredient_view(rows: DataFrame) -> DataFrame:
    """Ingredients; a substance's code loses its padding here."""
    return rows.select("cis", "row_no", F.col("element").alias("element_pharmaceutique"), bare_code(F.col("code_substance")).alias("code_substance"), "denomination_substance", "dosage", F.col("reference_dosage"), "nature", "numero_liaison")


def opinion_view(rows: DataFrame) -> DataFrame:
    """Opinions of either family; the level is null where the value is no level."""
    level = F.col("niveau") if "niveau" in rows.columns else F.lit(None).cast("int")
    return rows.select("cis", "row_no", "code_dossier_has", "motif_evaluation", _day("date_avis"), "valeur", level.alias("niveau"), "libelle", _text("lien_avis_ct"))


def shortage_view(rows: DataFrame) -> DataFrame:
    return rows.select("cis", "row_no", "cip13", "code_statut", "statut", "libelle", "libelle_source", _day("date_debut"), "date_debut_approximative", _day("date_mise_a_jour"), _day("date_remise_disposition"), F.col("lien").alias("lien_ansm"))


def mitm_view(rows: DataFrame) -> DataFrame:
    return rows.select("cis", "row_no", "code_atc", "denomination", F.col("lien").alias("lien_bdpm"), F.concat(F.lit(DRUGS), "cis").alias("_link"))


def substance_view(rows: DataFrame) -> DataFrame:
    """Substances; codes keep their padding here."""
    return rows.select(F.col("code_substance").alias("code"), F.col("denomination_substance").alias("denomination"), F.col("nombre_specialites").alias("nb_specialites"), F.concat(F.lit(SUBSTANCES), "code_substance", F.lit("/medicaments")).alias("medicaments"))


def group_view(c: Catalogue) -> DataFrame:
    """Groups with their members in order; unknown members are left out, their group stays."""
    each = c.groupes_generiques.select("groupe_id", F.posexplode("members").alias("at", "m")).select("groupe_id", "at", "m.*")
    known = each.join(c.specialites.select("cis", "denomination", "etat_commercialisation"), "cis")
    view = F.struct("cis", "denomination", "type", F.coalesce(lookup(F.col("type"), GENERIC_VIEW), F.lit("")).alias("type_libelle"), "ordre", "etat_commercialisation", F.concat(F.lit(DRUGS), "cis").alias("_link"))
    members = relations.nested(known, "groupe_id", ["at"], view, "membres")
    empty = f"array<{members.schema['membres'].dataType.elementType.simpleString()}>"
    return c.groupes_generiques.select("groupe_id", "libelle").join(members, "groupe_id", "left").select(F.col("groupe_id").alias("id"), "libelle", F.coalesce("membres", F.array().cast(empty)).alias("membres"))


def list_view(c: Catalogue) -> DataFrame:
    """Drugs for choosing: with distinct substance names in order, number of packs and membership."""
    packs = c.presentations.groupBy("cis").agg(F.count(F.lit(1)).alias("nb_presentations"))
    named = relations.nested(c.composants.where("denomination_substance <> ''"), "cis", ["row_no"], F.col("denomination_substance"), "substances")
    major = c.mitm.select("cis", F.lit(True).alias("mitm")).distinct()
    out = c.specialites.join(packs, "cis", "left").join(named, "cis", "left").join(major, "cis", "left")
    link = F.concat(F.lit(DRUGS), "cis")
    return out.select(
        "cis", "row_no", "denomination", "forme_pharmaceutique", _listed("voies_administration"), "statut_amm", "etat_commercialisation", _day("date_amm"), _listed("titulaires"), "surveillance_renforcee",
        F.array_distinct(F.coalesce("substances", F.array().cast("array<string>"))).alias("substances"), F.coalesce("nb_presentations", F.lit(0)).alias("nb_presentations"), F.coalesce("mitm", F.lit(False)).alias("mitm"),
        F.struct(link.alias("self"), F.concat(link, F.lit("/presentations")).alias("presentations")).alias("_links"),
    )


def _inner(view: DataFrame) -> Column:
    return F.struct(*[n for n in view.columns if n not in ("cis", "row_no")])


def sub_resource(c: Catalogue, section: str) -> DataFrame:
    """cis and one section of its record: an array, or for groups and opinions a struct."""
    views = {"presentations": lambda: pack_view(c.presentations), "composition": lambda: ingredient_view(c.composants), "ruptures": lambda: shortage_view(c.ruptures)}
    if section in views:
        view = views[section]()
        return relations.nested(view, "cis", ["row_no"], _inner(view), section)
    if section == "conditions":
        return relations.nested(c.conditions, "cis", ["row_no"], F.col("condition"), section)
    if section == "generiques":
        member = c.groupes_generiques.select("groupe_id", F.explode("members.cis").alias("cis"))
        last = member.join(group_rank(c), "groupe_id").groupBy("cis").agg(F.max_by("groupe_id", "rank").alias("id"))
        return last.join(group_view(c), "id").select("cis", F.struct("id", "libelle", "membres").alias(section))
    if section == "avis":
        smr, asmr = (opinion_view(rows) for rows in (c.avis_smr, c.avis_asmr))
        both = relations.nested(smr, "cis", ["row_no"], _inner(smr), "smr").join(relations.nested(asmr, "cis", ["row_no"], _inner(asmr), "asmr"), "cis", "full")
        return both.select("cis", F.struct(F.coalesce("smr", F.array()).alias("smr"), F.coalesce("asmr", F.array()).alias("asmr")).alias(section))
    raise params.ParameterError(f"unknown section {section}")


def group_rank(c: Catalogue) -> DataFrame:
    """groupe_id and a sortable rank in list order: short numbers by value, then other ids by text."""
    number = F.when(F.col("groupe_id").rlike(r"\A[0-9]{1,9}\z"), F.lpad("groupe_id", 9, "0"))
    return c.groupes_generiques.select("groupe_id", F.concat(F.when(number.isNull(), "1").otherwise("0"), F.coalesce(number, "groupe_id")).alias("rank"))


def full_view(c: Catalogue, include: str | None = None) -> DataFrame:
    """Drugs for reading, with the sections that ``include`` names; an array section is never null."""
    first = c.mitm.groupBy("cis").agg(F.min_by(F.struct("code_atc", "denomination", F.col("lien").alias("lien_bdpm")), "row_no").alias("mitm"))
    out = c.specialites.join(first, "cis", "left").select(
        "cis", "row_no", "denomination", "forme_pharmaceutique", _listed("voies_administration"), "statut_amm", "procedure_amm", "etat_commercialisation", _day("date_amm"), "statut_bdm", _text("numero_autorisation_europeenne"), _listed("titulaires"), "surveillance_renforcee", "mitm",
    )
    wanted = params.sections(include, SECTIONS)
    arrays = [s for s in wanted if s not in ("generiques", "avis")]
    out = relations.expand(out, "cis", {s: sub_resource(c, s) for s in arrays})
    for section in wanted:
        if section not in arrays:
            out = out.join(sub_resource(c, section), "cis", "left")
    return out


# Links


def ingredient_substance(c: Catalogue) -> DataFrame:
    """Ingredients with the substance of the same numeric code; null where there is none."""
    known = c.substances.select(bare_code(F.col("code_substance")).alias("__code"), F.col("code_substance").alias("substance")).groupBy("__code").agg(F.max("substance").alias("substance"))
    return c.composants.join(known, bare_code(F.col("code_substance")) == F.col("__code"), "left").drop("__code")


def shortage_pack(c: Catalogue) -> DataFrame:
    """Shortages with the row of their pack; null for those of a whole drug."""
    packs = c.presentations.groupBy(F.col("cip13").alias("__cip")).agg(F.max("row_no").alias("pack_row"))
    return c.ruptures.join(packs, F.col("cip13") == F.col("__cip"), "left").drop("__cip")


# Look-ups


def _answered(asked: DataFrame, view: DataFrame, on: Column, name: str) -> DataFrame:
    """Asked keys with their record, null where there is none."""
    held = view.select(on.alias("key"), F.struct(*view.columns).alias(name))
    return asked.join(held, "key", "left").withColumn("found", F.col(name).isNotNull())


def asked_only(c: Catalogue, keys: DataFrame) -> Catalogue:
    """The tables' rows of the drugs in ``keys`` (cis); by broadcast where they are few. Groups stay whole."""
    few = near(keys.select("cis").distinct())
    return Catalogue(**{name: df.join(few, "cis", "left_semi") if "cis" in df.columns else df for name, df in vars(c).items()})


def look_up_drugs(c: Catalogue, asked: DataFrame, include: str | None = None) -> DataFrame:
    """``asked`` (key: an eight-digit code) with found and the full record; views are made of the asked drugs alone."""
    return _answered(asked, full_view(asked_only(c, asked.select(F.col("key").alias("cis"))), include), F.col("cis"), "medicament")


def look_up_packs(c: Catalogue, asked: DataFrame) -> DataFrame:
    """``asked`` (key: 7 or 13 digits, which decides the code meant) with found, the pack and its drug.

    Of packs with the same short code the last one counts.
    """
    keys = near(asked.select("key").distinct())
    # Every pack under both its codes; only asked ones meet their drug.
    coded = pack_view(c.presentations).withColumn("key", F.explode(F.array("cip13", "cip7"))).join(keys, "key", "left_semi")
    view = parent_ref(coded, c.specialites)
    record = F.struct(*[n for n in view.columns if n != "key"])
    last = view.groupBy("key").agg(F.max_by(record, "row_no").alias("presentation"))
    return asked.join(last, "key", "left").withColumn("found", F.col("presentation").isNotNull())


def look_up_substances(c: Catalogue, asked: DataFrame) -> DataFrame:
    return _answered(asked, substance_view(c.substances), F.col("code"), "substance")


def look_up_groups(c: Catalogue, asked: DataFrame) -> DataFrame:
    return _answered(asked, group_view(c), F.col("id"), "groupe")


# Lists


@dataclass(frozen=True)
class DrugFilter:
    """Typed parameters of the drug list; None and empty texts don't filter."""

    commercialise: bool | None = None
    statut_amm: str | None = None
    procedure_amm: tuple[str, ...] | None = None
    forme: str = ""
    voie: str = ""
    titulaire: str = ""
    surveillance: bool | None = None
    mitm: bool | None = None
    substance: str = ""
    generique: int | None = None
    remboursable: bool | None = None
    rupture: bool | None = None

    @classmethod
    def parse(cls, request: Mapping[str, str]) -> DrugFilter:
        """From request parameters; unknown ones are ignored, bad ones raise ParameterError."""
        get = request.get
        flags = {n: params.boolean(get(n)) for n in ("commercialise", "surveillance", "mitm", "remboursable", "rupture")}
        texts = {n: params.query_text(get(n)) for n in ("forme", "voie", "titulaire", "substance")}
        return cls(statut_amm=params.enum(get("statut_amm"), filters.AUTHORISATION), procedure_amm=params.enum(get("procedure_amm"), filters.PROCEDURE), generique=params.enum(get("generique"), filters.ROLE), **flags, **texts)


def with_substance(c: Catalogue, value: str) -> DataFrame:
    """cis of drugs with an ingredient of this code (without padding), or whose name holds the value."""
    return c.composants.where(filters.code_or_name(bare_code(F.col("code_substance")), F.col("denomination_substance"), value)).select("cis")


def with_role(c: Catalogue, role: int) -> DataFrame:
    """cis of drugs whose role in their last group is ``role``."""
    each = c.groupes_generiques.select("groupe_id", F.explode("members").alias("m")).join(group_rank(c), "groupe_id")
    last = each.groupBy(F.col("m.cis").alias("cis")).agg(F.max_by("m.type", F.struct("rank", "m.ordre")).alias("type"))
    return last.where(F.col("type") == role).select("cis")


def drugs_where(c: Catalogue, wanted: DrugFilter) -> DataFrame:
    """Drugs that pass all filters: column predicates reach the scan, memberships are semi or anti joins."""
    out = c.specialites
    if wanted.commercialise is not None:
        out = out.where(filters.equals_flag(F.col("etat_commercialisation"), "Commercialisée", wanted.commercialise))
    if wanted.statut_amm is not None:
        out = out.where(F.col("statut_amm") == wanted.statut_amm)
    if wanted.procedure_amm is not None:
        out = out.where(F.col("procedure_amm").isin(*wanted.procedure_amm))
    if wanted.forme:
        out = out.where(filters.equals_ignoring_case(F.col("forme_pharmaceutique"), wanted.forme))
    if wanted.voie:
        out = out.where(filters.any_equals(F.col("voies_administration"), wanted.voie))
    if wanted.titulaire:
        out = out.where(filters.any_norm_contains(F.col("titulaires"), wanted.titulaire))
    if wanted.surveillance is not None:
        out = out.where(F.col("surveillance_renforcee") == wanted.surveillance)
    members = [
        (wanted.mitm, c.mitm),
        (True if wanted.substance else None, with_substance(c, wanted.substance)),
        (None if wanted.generique is None else True, with_role(c, wanted.generique or 0)),
        (wanted.remboursable, c.presentations.where(F.size(rates(F.col("taux_remboursement"))) > 0)),
        (wanted.rupture, c.ruptures),
    ]
    for flag, rows in members:
        if flag is not None:
            out = relations.member(out, rows, "cis", flag)
    return out


def drug_list(c: Catalogue, request: Mapping[str, str], index: search.Index | None = None, version: str = "") -> paging.Page:
    """The drug list of a request: filters, ranked query text ``q``, order ``sort``, page.

    Without a query the order by relevance is that by name; equal keys keep
    the order of relevance, or of the file.
    """
    wanted = DrugFilter.parse(request)
    text = params.query_text(request.get("q"))
    order = params.enum(request.get("sort"), {s: s for s in SORTS}) or "pertinence"
    limit = params.limit(request.get("limit"))
    rows = drugs_where(c, wanted)
    ties: list[Column] = [F.col("row_no")]
    score = F.lit(None).cast("double")
    if text:
        docs = c.specialites.select(F.col("cis").alias("id"), F.col("denomination").alias("name"), "etat_commercialisation", "statut_amm")
        if index is None:
            raise ValueError("a query text needs a search index")
        found = search.find(docs, index, text, marketed=F.col("etat_commercialisation") == "Commercialisée", active=F.col("statut_amm").startswith("Autorisation active"))
        rows = rows.join(found.hits.select(F.col("id").alias("cis"), "score"), "cis")
        score, ties = F.col("score"), [F.desc("score"), F.col("cis")]
    elif order == "pertinence":
        order = "denomination"
    keys = {"pertinence": [], "denomination": [normalize(F.col("denomination"))], "date_amm": [F.col("date_amm").desc_nulls_last()]}[order]
    chosen = rows.select("cis", "row_no", "denomination", "date_amm", score.alias("score"))
    page = paging.paginate(chosen, [*keys, *ties], request.get("cursor", ""), limit, version)
    return page


def page_of_views(c: Catalogue, page: paging.Page) -> DataFrame:
    """List views of a page's drugs, with their score; the page is small, so the tables are joined with it by broadcast."""
    keys = page.rows.select("cis", "score")
    near = lambda df: df.join(F.broadcast(keys.select("cis")), "cis", "left_semi")
    part = Catalogue(**{n: near(df) if n in ("specialites", "presentations", "composants", "mitm") else df for n, df in vars(c).items()})
    return list_view(part).join(F.broadcast(keys), "cis")


def substance_list(c: Catalogue, q: str = "") -> DataFrame:
    """Substances whose name holds the text or whose code is it; all for a text without letters and digits."""
    view = substance_view(c.substances)
    return view.where(filters.norm_contains(F.col("denomination"), q) | (F.col("code") == q)).orderBy("code")


def group_list(c: Catalogue, q: str = "") -> DataFrame:
    view = group_view(c)
    ranked = view.join(group_rank(c).withColumnRenamed("groupe_id", "id"), "id")
    return ranked.where(filters.norm_contains(F.col("libelle"), q)).orderBy("rank").drop("rank")


def drugs_of_substance(c: Catalogue, code: str) -> DataFrame:
    """Distinct drugs with an ingredient of this substance, in file order."""
    return relations.member(list_view(c), c.composants.where(bare_code(F.col("code_substance")) == code.lstrip("0")), "cis").orderBy("row_no")


def shortage_list(c: Catalogue, request: Mapping[str, str]) -> DataFrame:
    """Shortages newest first; equal days in order of drugs, then of the file."""
    state = params.enum(request.get("statut"), {k: k for k in filters.SHORTAGE_FILTER})
    key = F.col("cis") == params.code(request["cis"], 8) if request.get("cis") else None
    active = params.boolean(request.get("actives"))
    placed = c.ruptures.join(c.specialites.select("cis", F.col("row_no").alias("drug_row")), "cis")
    return filters.shortages(placed, state, key, request.get("depuis") or None, True if active is None else active, ties=("drug_row", "row_no"))


def mitm_list(c: Catalogue, atc: str = "") -> DataFrame:
    """Drugs of major interest; ``atc`` is a prefix of their code, an extra."""
    view = parent_ref(mitm_view(c.mitm), c.specialites).drop("medicament")
    return (view.where(F.col("code_atc").startswith(atc)) if atc else view).orderBy("row_no")
