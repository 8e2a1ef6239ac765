"""Views, look-ups and lists on three drugs, and on what the end-to-end load publishes."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.params import ParameterError
from quarry.operators import catalogue, search

DRUG = "cis string, row_no long, denomination string, forme_pharmaceutique string, voies_administration array<string>, statut_amm string, procedure_amm string, etat_commercialisation string, date_amm string, statut_bdm string, numero_autorisation_europeenne string, titulaires array<string>, surveillance_renforcee boolean"
PACK = "cis string, row_no long, cip13 string, cip7 string, libelle string, statut_administratif string, etat_commercialisation string, date_declaration string, agrement_collectivites boolean, taux_remboursement array<int>, prix_medicament_cents int, prix_public_cents int, honoraires_cents int, indications_remboursement string"
PART = "cis string, row_no long, element string, code_substance string, denomination_substance string, dosage string, reference_dosage string, nature string, numero_liaison int"
OPINION = "cis string, row_no long, code_dossier_has string, motif_evaluation string, date_avis string, valeur string, libelle string, lien_avis_ct string"
SHORTAGE = "cis string, row_no long, cip13 string, code_statut int, statut string, libelle string, libelle_source string, date_debut string, date_debut_approximative boolean, date_mise_a_jour string, date_remise_disposition string, lien string"
GROUP = "groupe_id string, libelle string, members array<struct<ordre:int,cis:string,type:int>>"


@pytest.fixture(scope="module")
def c(spark):
    make = spark.createDataFrame
    a, b, d = "60000001", "60000002", "60000003"
    return catalogue.Catalogue(
        make([(a, 1, "Zolimal fort, comprimé", "comprimé", ["orale"], "Autorisation active", "Procédure nationale", "Commercialisée", "1999-01-02", None, "", ["LABO UN"], False), (b, 2, "ÉLIXAN codéine", "comprimé", [], "Autorisation active", "", "Non commercialisée", "2001-02-03", "Alerte", "EU/2", ["LABO UN"], True), (d, 3, "Amovent gélule", "gélule", ["nasale"], "Autorisation active", "", "Commercialisée", None, None, "", ["Viätor santé"], False)], DRUG),
        make([(a, 1, "3400930000011", "3000001", "boîte", "Présentation active", "Déclaration de commercialisation", "2001-01-01", True, [65, 120], 2434, None, None, ""), (a, 2, "3400930000028", "3000002", "flacon", "", "", None, None, None, None, None, None, "texte")], PACK),
        make([(a, 1, "comprimé", "02202", "PARAXÉTOL", "1 g", "un", "SA", 1), (b, 2, "", "02202", "PARAXÉTOL", "400 mg", "", "SA", 1), (d, 3, "", "12345", "BÉSILATE", "6 mg", "", "SA", 1), (d, 4, "", "12345", "BÉSILATE", "6 mg", "", "FT", 2)], PART),
        make([(a, 1, "CT-1", "m", "2015-06-10", "Important", "l", None)], OPINION),
        make([(a, 1, "CT-1", "m", "2015-06-10", "IV", "l", "https://x", 4), (b, 2, "CT-2", "m", None, "Commentaires", "l", None, None)], OPINION + ", niveau int"),
        make([("02202", "PARAXÉTOL", 2), ("12345", "BÉSILATE", 1)], "code_substance string, denomination_substance string, nombre_specialites long"),
        make([("10", "DIX", [(2, b, 1), (1, a, 0), (3, "69999999", 1)]), ("9", "NEUF", [(1, b, 4)]), ("x", "VIDE", [(1, "69999999", 0)])], GROUP),
        make([(d, 1, "liste I")], "cis string, row_no long, condition string"),
        make([(a, 1, None, 2, "tension_approvisionnement", "Tension", "T", "2026-01-05", False, "2026-02-01", None, "https://a"), (a, 2, "3400930000028", 1, "rupture_stock", "Rupture", "R", "2026-01-05", False, "2026-02-01", None, "https://b"), (b, 3, None, 2, "tension_approvisionnement", "Tension", "T", "2026-01-05", False, "2026-03-01", "2026-04-01", "https://c")], SHORTAGE),
        make([(d, 1, "C08CA01", "AMOVENT", "https://m")], "cis string, row_no long, code_atc string, denomination string, lien string"),
    )


def test_list_totals(c):
    for request, total in {
        "": 3,
        "commercialise=true": 2,
        "commercialise=false": 1,
        "surveillance=true": 1,
        "forme=GÉLULE": 1,
        "voie=Orale": 1,
        "titulaire=viator": 1,
        "titulaire=!!!": 3,
        "substance=PARAXETOL": 2,
        "substance=2202": 2,
        "substance=02202": 0,
        "mitm=true": 1,
        "mitm=false": 2,
        "remboursable=true": 1,
        "rupture=true": 2,
        "generique=princeps": 1,
        "generique=generique": 1,
        "generique=substituable": 0,
        "statut_amm=active": 3,
        "procedure_amm=nationale": 1,
        "substance=PARAXETOL&commercialise=true": 1,
        "commercialise=true&surveillance=true": 0,
    }.items():
        wanted = catalogue.DrugFilter.parse(dict(p.split("=") for p in request.split("&") if p))
        assert catalogue.drugs_where(c, wanted).count() == total, request
    with pytest.raises(ParameterError):
        catalogue.DrugFilter.parse({"commercialise": "maybe"})


def test_list_order_and_pages(spark, c, tmp_path):
    codes = lambda request, **k: [r["cis"][-1] for r in catalogue.drug_list(c, request, version="v", **k).rows.collect()]
    assert codes({}) == ["3", "2", "1"]
    assert codes({"sort": "date_amm"}) == ["2", "1", "3"]
    first = catalogue.drug_list(c, {"limit": "2"}, version="v")
    assert first.meta["total"] == 3 and first.meta["has_more"] and first.meta["limit"] == 2
    assert codes({"limit": "2", "cursor": first.next_cursor}) == ["1"]
    names = c.specialites.select(F.col("cis").alias("id"), F.col("denomination").alias("text"))
    search.publish_index(search.postings(search.field_texts(names, ["text"])), names, f"file://{tmp_path}/i")
    index = search.open_index(spark, f"file://{tmp_path}/i")
    page = catalogue.drug_list(c, {"q": "elixan", "mitm": "false"}, index, "v")
    (hit,) = catalogue.page_of_views(c, page).collect()
    assert hit["cis"] == "60000002" and hit["score"] > 0 and hit["substances"] == ["PARAXÉTOL"]
    assert catalogue.drug_list(c, {"q": "elixan", "commercialise": "true"}, index, "v").total == 0


def test_views(c):
    full = {r["cis"][-1]: r for r in catalogue.full_view(c, "all").collect()}
    one = full["1"]
    assert [p["cip13"] for p in one["presentations"]] == ["3400930000011", "3400930000028"]
    assert one["presentations"][0]["taux_remboursement"] == [65] and one["presentations"][1]["taux_remboursement"] == []
    assert one["presentations"][0]["indications_remboursement"] is None and one["presentations"][1]["prix_medicament_cents"] is None
    assert one["composition"][0]["code_substance"] == "2202" and one["avis"]["asmr"][0]["niveau"] == 4 and one["avis"]["smr"][0]["niveau"] is None
    assert full["2"]["generiques"]["id"] == "10" and full["3"]["generiques"] is None
    assert full["3"]["presentations"] == [] and full["3"]["conditions"] == ["liste I"] and full["3"]["mitm"]["code_atc"] == "C08CA01"
    assert full["2"]["numero_autorisation_europeenne"] == "EU/2" and one["numero_autorisation_europeenne"] is None
    assert "avis" not in catalogue.full_view(c, "conditions").columns
    groups = {r["id"]: r["membres"] for r in catalogue.group_view(c).collect()}
    assert len(groups["10"]) == 2 and groups["x"] == [] and groups["9"][0]["type_libelle"] == "générique substituable"
    short = {r["cis"][-1]: (r["nb_presentations"], r["mitm"]) for r in catalogue.list_view(c).collect()}
    assert short == {"1": (2, False), "2": (0, False), "3": (0, True)}
    with pytest.raises(ParameterError):
        catalogue.sub_resource(c, "nothing")


def test_look_ups_and_links(spark, c):
    ask = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    packs = {r["key"]: r["presentation"] and r["presentation"]["cip7"] for r in catalogue.look_up_packs(c, ask("3000002", "3400930000011", "3400930000099")).collect()}
    assert packs == {"3000002": "3000002", "3400930000011": "3000001", "3400930000099": None}
    assert {r["key"]: r["found"] for r in catalogue.look_up_drugs(c, ask("60000003", "1")).collect()} == {"60000003": True, "1": False}
    assert catalogue.look_up_substances(c, ask("02202")).first()["substance"]["nb_specialites"] == 2
    assert catalogue.look_up_groups(c, ask("9")).first()["groupe"]["libelle"] == "NEUF"
    assert {r["row_no"]: r["pack_row"] for r in catalogue.shortage_pack(c).collect()} == {1: None, 2: 2, 3: None}
    assert {r["substance"] for r in catalogue.ingredient_substance(c).collect()} == {"02202", "12345"}
    assert [r["row_no"] for r in catalogue.shortage_list(c, {}).collect()] == [1, 2]
    assert [r["row_no"] for r in catalogue.shortage_list(c, {"actives": "false", "statut": "tension"}).collect()] == [3, 1]
    assert [r["code"] for r in catalogue.substance_list(c, "12345").collect()] == ["12345"] and len(catalogue.substance_list(c, "!").collect()) == 2
    assert [r["id"] for r in catalogue.group_list(c).collect()] == ["9", "10", "x"]
    assert [r["cis"][-1] for r in catalogue.drugs_of_substance(c, "02202").collect()] == ["1", "2"]
    assert catalogue.mitm_list(c, "C08").count() == 1 and catalogue.mitm_list(c, "A").count() == 0
