"""End to end: ten small dirty files to a published snapshot."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators.quality import GateError, Gates
from quarry.plans import ingest
from quarry.sources import catalog, scan, snapshot

LINES = {
    "CIS_bdpm.txt": ["60000001\tDOLIX 500 mg\tcomprimé\torale\tAutorisation active\tProcédure nationale\tCommercialisée\t01/02/2003\t\t\t LABO A;LABO B\tNon", "60000002\tZÉTA\tgélule\torale;nasale\tAutorisation étrange\tProcédure nationale\tNon commercialisée\t05/06/2010\tAlerte\tEU/1\tLABO C\tOui", "60000001\tDOUBLE\tx\ty\tAutorisation active\tProcédure nationale\tCommercialisée\t01/02/2003\t\t\tL\tNon", "6000000X\tbad\tx\ty\tz\tp\te\t99/99/9999\t\t\tL\tNon", "60000003\ttoo\tfew"],
    "CIS_CIP_bdpm.txt": ["60000001\t1234567\tboîte\tPrésentation active\tDéclaration de commercialisation\t01/01/2020\t3400912345678\toui\t65 %\t24,34\t1,003,48\t1,02\t", "60000002\t1234568\tflacon\tPrésentation active\tDéclaration de commercialisation\t01/01/2020\t3400912345679\tinconnu\t\t\t\t\t\"note\"", "69999999\t1234569\torphan\tPrésentation active\tDéclaration de commercialisation\t01/01/2020\t3400912345670\tnon\t\t\t\t\t"],
    "CIS_COMPO_bdpm.txt": ["60000001\tcomprimé\t01234\tPARACÉTAMOL\t 500 mg\tun comprimé\tSA\t1", "60000002\tgélule\t01234\tPARACETAMOL BIS\t1 g\tune\tST\t2", "60000002\tgélule\t777\tCODÉINE\t1 g\tune\tXX\t2"],
    "CIS_HAS_SMR_bdpm.txt": ["60000001\tCT-1\tInscription\t20200102\tImportant\ttexte"],
    "CIS_HAS_ASMR_bdpm.txt": ["60000001\tCT-1\tInscription\t20200102\tIV\ttexte", "60000001\tCT-2\tInscription\t20201302\tIV\ttexte"],
    "HAS_LiensPageCT_bdpm.txt": ["CT-1\thttp://old", "CT-1\thttp://new", "\thttp://x"],
    "CIS_GENER_bdpm.txt": ["12\tGROUPE DOUZE\t60000002\t1\t2", "12\tautre\t60000001\t0\t1", "9\tORPHELIN\t69999999\t0\t1", "9\tx\t60000001\t3\t1"],
    "CIS_CPD_bdpm.txt": ["60000001\tliste I", "60000001\tliste II"],
    "CIS_CIP_Dispo_Spec.txt": ["60000001\t3400912345678\t1\tRupture\t01/01/2023\t02/02/2024\t\thttp://a", "60000002\t3400900000000\t4\tRemise\t01/01/2024\t02/02/2024\t03/03/2024\thttp://b", "60000002\t\t7\t?\t01/01/2024\t02/02/2024\t\t"],
    "CIS_MITM.txt": ["60000001\tN02BE01\tDOLIX\thttp://m"],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("source")
    for name, lines in LINES.items():
        code = "utf-8" if name in ("CIS_CIP_bdpm.txt", "HAS_LiensPageCT_bdpm.txt") else "cp1252"
        (path / name).write_bytes("\r\n".join(lines).encode(code))
    return f"file://{path}"


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return ingest.parse(spark, folder)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_tables(loaded):
    t = loaded.tables
    assert rows(t["specialites"], "cis", "denomination") == [("60000001", "DOLIX 500 mg"), ("60000002", "ZÉTA")]
    assert rows(t["presentations"], "cip13", "prix_medicament_cents", "prix_public_cents", "agrement_collectivites") == [("3400912345678", 2434, 100348, True), ("3400912345679", None, None, None)]
    assert rows(t["composants"], "dosage", "nature") == [(" 500 mg", "SA"), ("1 g", "FT")]
    assert rows(t["substances"], "code_substance", "denomination_substance", "nombre_specialites") == [("01234", "PARACÉTAMOL", 2)]
    assert rows(t["avis_asmr"], "code_dossier_has", "niveau", "lien_avis_ct") == [("CT-1", 4, "https://new")]
    assert rows(t["ruptures"], "cis", "cip13", "statut", "date_debut_approximative") == [("60000001", "3400912345678", "rupture_stock", True), ("60000002", None, "remise_disposition", False)]
    (group,) = t["groupes_generiques"].collect()
    assert group["libelle"] == "GROUPE DOUZE" and [m["cis"] for m in group["members"]] == ["60000001", "60000002"]


def test_routing(loaded):
    assert rows(loaded.rejects, "file", "reason") == sorted(
        [("CIS_bdpm.txt", "cis_duplique"), ("CIS_bdpm.txt", "cis_invalide"), ("CIS_bdpm.txt", "column_count"), ("CIS_COMPO_bdpm.txt", "nature_invalide"), ("CIS_HAS_ASMR_bdpm.txt", "date_invalide"), ("HAS_LiensPageCT_bdpm.txt", "code_dossier_has_vide"), ("CIS_GENER_bdpm.txt", "type_generique_inconnu"), ("CIS_CIP_Dispo_Spec.txt", "code_statut_inconnu")],
        key=str,
    )
    assert rows(loaded.scope, "file", "reason") == [("CIS_CIP_Dispo_Spec.txt", "cip13_orphelin"), ("CIS_CIP_bdpm.txt", "cis_orphelin"), ("CIS_GENER_bdpm.txt", "cis_orphelin")]
    assert ("CIS_bdpm.txt", "statut_amm", "Autorisation étrange", 1) in rows(loaded.unknown, "file", "field", "value", "n")
    assert ("CIS_bdpm.txt", "windows-1252", "crlf", 5) in rows(loaded.files, "name", "encoding", "line_ending", "lines")


def test_publish(spark, folder, tmp_path):
    root, easy = f"file://{tmp_path}/snapshots", Gates(reject_ratio=1, scope_ratio=1, floor=1)
    assert snapshot.current(spark, root) is None
    with pytest.raises(GateError) as e:
        ingest.sync(spark, folder, root, Gates(floor=1))
    assert e.value.gate == "taux_rejet" and snapshot.current(spark, root) is None
    assert ingest.sync(spark, folder, root, easy, dry_run=True) == "checked"
    assert ingest.sync(spark, folder, root, easy) == "published"
    assert ingest.sync(spark, folder, root, easy) == "unchanged"
    manifest = snapshot.current(spark, root)
    tables = snapshot.load(spark, root, manifest)
    assert tables["specialites"].count() == 2 and "liens_ct" not in tables
    assert ingest.sync(spark, folder, root, easy, force=True) == "published"
    again = snapshot.current(spark, root)
    assert again.folder == f"{manifest.hash}-2" and snapshot.load(spark, root, again)["specialites"].count() == 2 and tables["mitm"].count() == 1
    assert again.quarantine["by_file"]["CIS_bdpm.txt"] == 3 and {w["kind"] for w in again.warnings} == {"rejet", "hors_perimetre", "valeur_inconnue"} and len(again.files) == 10
    line = next(p for p in (tmp_path / "snapshots" / manifest.hash / "presentations").glob("part-*") if p.stat().st_size).read_text().splitlines()[-1]
    assert "prix_medicament_cents" in json.loads(line)
    broken = snapshot.Manifest(**{**manifest.__dict__, "counts": manifest.counts | {"mitm": 7}})
    with pytest.raises(GateError):
        snapshot.load(spark, root, broken)


def test_staged_files_are_those_read_whole(spark, tmp_path):
    contents = {"a.txt": b"\xef\xbb\xbfx\ty\r\nz\r\n", "b.txt": "\r\n".join(f"é{i}\t{i}" for i in range(200)).encode("cp1252"), "c.txt": b"", "d.txt": b"one\n\n  \n", "e.txt": b"one\r\ntwo\n", "f.txt": b"\x80 euro", "g.txt": b"a\r\nb\r"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        staged = scan.stage(spark, f"file://{tmp_path}", sorted(contents))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = scan.read_files(spark, f"file://{tmp_path}", sorted(contents)).select("name", scan.decode(F.col("content")).alias("text"), scan.encoding(F.col("content")).alias("e"))
    assert rows(scan.fields(staged.lines), "name", "line_no", "line") == rows(scan.lines(whole), "name", "line_no", "line")
    facts = whole.where("text <> ''").select("name", scan.line_count(F.col("text")).alias("lines"), F.col("e").alias("encoding"), scan.line_ending(F.col("text")).alias("line_ending"))
    assert rows(staged.facts, *facts.columns) == rows(facts, *facts.columns)
    with pytest.raises(scan.ScanError):
        scan.stage(spark, f"file://{tmp_path}", [])


def test_missing_file(spark, folder):
    with pytest.raises(Exception):  # noqa: B017 the reader's own error names the path
        scan.stage(spark, folder, [*catalog.specs(), "nothing.txt"])
    with pytest.raises(Exception):  # noqa: B017 the reader's own error names the path
        scan.read_files(spark, folder, [*catalog.specs(), "nothing.txt"]).count()


def test_surplus():
    found = [("a", 1), ("b", 3), ("c", 3), ("d", 2)]
    assert snapshot.surplus(found, 2, "a") == ["d"]
    assert snapshot.surplus(found, 0, None) == []


def test_lines_are_parsed_once(spark, folder):
    loaded = ingest.parse(spark, folder)
    # What is read later are parsed rows: no plan takes a line apart again.
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (*loaded.tables.values(), loaded.rejects, loaded.scope)]
    assert not [p for p in plans if "split(" in p]
    loaded.release()
