"""Parser contracts on small files in the raw layouts, and the sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import readers as R
from tidegauge.sources import writers as W
from tidegauge.sources.schema import MEASUREMENT

TARGETS = R.Targets("T4", "ACC4", {"ACC1": "T1", "ACC4": "T4"}, {"CH1": "T1"}, ("T1", "T4"))
S = "PUBCHEM_EXT_DATASOURCE_SMILES"


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    meta = lambda n: [f"META{i}," for i in range(n)]
    put(f"{root}/pubchem", "AID_1_datatable_all.csv", [f"{S},Standard Type,Standard Relation,Standard Units,Standard Value,PubChem Standard Value,DOI"] + meta(5) + [
        "CCO,IC50,=,nM,120,,10.1/x", "CCN,Ki,>,uM,,2.5,", ",IC50,=,nM,1,,", "CCC,IC50,=,nM,-3,,"])
    put(f"{root}/pubchem", "AID_2_datatable_all.csv", [f"{S},IC50,IC50 Qualifier,Target Accession(s),Has Dose Response,Max conc"] + meta(5) + [
        "CCO,50,>=,ACC4,True,10", "CCO,60,?,ACC4,,x", "CCO,70,=,OTHER,,", "CCO,n.d.,=,ACC4,,"])
    put(f"{root}/pubchem", "AID_3_datatable_all.csv", [f"{S},Ki,IC50,Target Accession(s)"] + meta(4) + [
        "CCO,5,9,xx ACC1", "CCN,,9,", "CCC,-1,9,ACC4"])
    put(f"{root}/pubchem", "AID_4_datatable_all.csv", [f"{S},Inhibition at 10 uM,Concentration"] + meta(4) + [
        "CCO,130,10", "CCN,-20,", "CCC,3,10", "CCCC,abc,10"])
    put(f"{root}/pubchem", "AID_5_datatable_all.csv", [f"{S},Pct Inhibition,Panel Name,Panel Target"] + meta(4) + [
        "CCO,50,zz,has ACC1 inside", "CCN,50,a T4 panel,none", "CCC,50,none,none"])
    put(f"{root}/pubchem", "AID_6_datatable_all.csv", [f"{S},Average IC50,Qualifier,Standard Deviation"] + meta(5) + ["CCO,1.5,<,0.2", "CCN,,=,1"])
    put(f"{root}/pubchem", "AID_9_datatable_all.csv", [f"{S},x"] + meta(4) + ["CCO,1"])
    put(f"{root}/bindingdb", "BindingDB_T1.tsv", ["Ligand SMILES\tKi (nM)\tIC50 (nM)\tUniProt (SwissProt) Primary ID of Target Chain 1\tArticle DOI",
        "CCO\t>= 12\t 34.5\tACC4\t10.2/y", "CCN\t\t<5\tZZZ\t", "CCC\tbad\t\tACC4\t", "CC\t1\t1\tACC4\t\textra\textra"])
    put(f"{root}/chembl", "CHEMBL_T4.tsv", ['"Smiles"\t"Standard Type"\t"Standard Relation"\t"Standard Value"\t"Standard Units"\t"Source ID"\t"Target ChEMBL ID""Target Name"',
        "\"CCO\"\t\"IC50\"\t\"'>'\"\t\"77\"\t\"nM\"\t\"1\"\t\"CH1\"\t\"n\"", "\"CCN\"\t\"IC50\"\t\"'='\"\t\"77\"\t\"nM\"\t\"37\"\t\"CH1\"\t\"n\"",
        "\"CCC\"\t\"EC50\"\t\"'='\"\t\"77\"\t\"nM\"\t\"1\"\t\"CH1\"\t\"n\""])
    return root


@pytest.fixture(scope="module")
def loaded(spark, raw):
    formats = dict(zip((f"AID_{i}" for i in range(1, 7)), "ABCDEF"))
    return R.load_measurements(spark, raw, formats, {"AID_5": "panel"}, TARGETS)


def rows(loaded, source):
    return loaded.filter(F.col("source_id") == source).orderBy("raw_smiles", "measurement_type").collect()


def test_schema_is_the_contract(loaded):
    assert loaded.columns == MEASUREMENT.names
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in MEASUREMENT]


def test_mirrored_units(loaded):
    ccn, cco = rows(loaded, "AID_1")
    assert (cco["activity_value_nM"], cco["original_unit"], cco["doi"]) == (120.0, "nM", "10.1/x")
    assert (ccn["activity_value_nM"], ccn["measurement_type"], ccn["qualifier"]) == (2500.0, "Ki", ">")


def test_dose_response_filters_target_and_qualifier(loaded):
    got = sorted((r["activity_value_nM"], r["qualifier"], r["has_dose_response"], r["screening_concentration_uM"]) for r in rows(loaded, "AID_2"))
    assert got == [(50.0, ">=", True, 10.0), (60.0, "=", False, None)]


def test_first_of_ki_and_ic50(loaded):
    got = {r["raw_smiles"]: (r["measurement_type"], r["activity_value_nM"], r["target_isoform"]) for r in rows(loaded, "AID_3")}
    assert got == {"CCO": ("Ki", 5.0, "T1"), "CCN": ("IC50", 9.0, "T4")}


def test_screen_clips_and_flags(loaded):
    got = {r["raw_smiles"]: (r["pct_inhibition"], r["is_artifact_high"], r["is_artifact_low"]) for r in rows(loaded, "AID_4")}
    assert got == {"CCO": (100.0, True, False), "CCN": (0.0, False, True)}


def test_panel_targets(loaded):
    got = {r["raw_smiles"]: (r["target_isoform"], r["assay_type"]) for r in rows(loaded, "AID_5")}
    assert got == {"CCO": ("T1", "panel"), "CCN": ("T4", "panel")}


def test_micromolar(loaded):
    (row,) = rows(loaded, "AID_6")
    assert (row["activity_value_nM"], row["sd_reported"], row["qualifier"]) == (1500.0, 200.0, "<")


def test_binding_unpivots_and_skips_long_lines(loaded):
    got = sorted((r["raw_smiles"], r["measurement_type"], r["qualifier"], r["activity_value_nM"], r["target_isoform"], r["doi"]) for r in rows(loaded, "BindingDB_T1"))
    assert got == [("CCN", "IC50", "<", 5.0, "T1", ""), ("CCO", "IC50", "=", 34.5, "T4", "10.2/y"), ("CCO", "Ki", ">=", 12.0, "T4", "10.2/y")]


def test_chembl_repairs_header_and_drops_mirrors(loaded):
    (row,) = rows(loaded, "CHEMBL_T4")
    assert (row["raw_smiles"], row["qualifier"], row["target_isoform"]) == ("CCO", ">", "T1")
    assert R.repair_header('"A"\t"B""C"') == ["A", "B", "C"]


def test_manifest_and_inventory(spark, loaded, raw):
    counts = {r["source_file"]: r["n_rows"] for r in R.ingest_manifest(loaded).collect()}
    assert counts["AID_1_datatable_all.csv"] == 2 and "AID_9_datatable_all.csv" not in counts
    inv = {r["filename"]: r for r in R.raw_inventory(spark, raw, {"AID_": "assay"}).collect()}
    one = inv["AID_1_datatable_all.csv"]
    assert one["lines"] == 10 and one["role"] == "assay" and one["header"].startswith(S) and len(one["sha256"]) == 64


def test_unknown_folder_raises(spark, tmp_path):
    with pytest.raises(Exception):
        R.load_measurements(spark, str(tmp_path), {}, {}, TARGETS)


def test_split_reader_prefers_locked_test(spark, tmp_path):
    put(str(tmp_path), "train.csv", ["id", "1"])
    put(str(tmp_path), "test.csv", ["id", "2"])
    put(str(tmp_path), "test_locked.csv", ["id", "3"])
    put(str(tmp_path), "val.csv", ["id"])
    got = R.read_split(spark, str(tmp_path))
    assert set(got) == {"train", "test"} and got["test"].first()["id"] == "3"


def test_metric_cells_flatten(spark, tmp_path):
    for strategy in ("random", "scaffold"):
        put(f"{tmp_path}/{strategy}/all", "metrics.json", [json.dumps({"val": {"rmse": 0.5, "ci": {"low": 0.4}}, "n": 3})])
    got = R.read_metric_cells(spark, str(tmp_path), ["strategy", "variant"]).orderBy("strategy").collect()
    assert got[1].asDict() == {"strategy": "scaffold", "variant": "all", "n": 3, "val_ci_low": 0.4, "val_rmse": 0.5}


def test_sinks(spark, tmp_path):
    frame = spark.range(20).withColumn("split", F.when(F.col("id") < 15, "train").otherwise("test"))
    W.write_split(frame, f"{tmp_path}/split", "regression", "random")
    back = spark.read.parquet(f"{tmp_path}/split")
    assert back.filter("split = 'test' AND strategy = 'random'").count() == 5
    assert len(W.file_manifest(spark, f"{tmp_path}/split").first()["md5"]) == 32
    assert W.run_cell(spark, f"{tmp_path}/cell", lambda: spark.range(3)) is True
    assert W.run_cell(spark, f"{tmp_path}/cell", lambda: spark.range(9)) is False
    digest = W.freeze(spark, f"{tmp_path}/frozen", {"seed": 1})
    assert digest == W.config_hash({"seed": 1}) and len(W.config_hash({}, 12)) == 12
    with pytest.raises(RuntimeError, match="frozen"):
        W.freeze(spark, f"{tmp_path}/frozen", {"seed": 2})
    W.freeze(spark, f"{tmp_path}/frozen", {"seed": 2}, force=True)
    W.write_contract(frame, {"id": "bigint", "absent": "double"}, f"{tmp_path}/contract", "id")
    assert spark.read.parquet(f"{tmp_path}/contract").columns == ["id", "absent"]
    text = W.render_table(spark.createDataFrame([("a", None)], "k string, v double"), 10)
    assert "--" in text["markdown"] and "tabular" in text["latex"]


def test_edge_columns_are_found_by_name(spark):
    from tidegauge.operators.joins import id_columns, normalise_edges
    from tidegauge.plans.curation import named_columns

    assert id_columns(["x", "inchikey_1", "inchikey_2"]) == ("inchikey_1", "inchikey_2")
    assert id_columns(["left_key_a", "left_key_b", "v"]) == ("left_key_a", "left_key_b")
    assert id_columns(["u", "v"]) is None
    edge = spark.createDataFrame([("ABCDEFGHIJKLMN-OPQ", "ZYXWVUTSRQPONM-LKJ", 0.9)], "id_a string, id_b string, similarity double")
    row = normalise_edges(edge).first()
    assert (row["src"], row["dst"], row["similarity"]) == ("ABCDEFGHIJKLMN", "ZYXWVUTSRQPONM", 0.9)
    with pytest.raises(ValueError, match="no id columns"):
        normalise_edges(spark.range(1).withColumnRenamed("id", "u"))
    frame = spark.createDataFrame([("a", 1.0)], "assay_date string, activity_class double")
    assert named_columns(frame) == {"date": ["assay_date"], "label": ["activity_class"]}
