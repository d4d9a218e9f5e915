"""Raw assay files to harmonised measurement rows.

Each file keeps its own header, so files are opened one by one (there are tens of
them); rows inside a file are parsed by column expressions in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import constants as K
from tidegauge.functions import expressions as X
from tidegauge.sources.schema import MEASUREMENT


@dataclass(frozen=True)
class Targets:
    """Which target a record belongs to: accession and target-id maps, in search order."""

    main_name: str
    main_accession: str
    by_accession: Mapping[str, str] = field(default_factory=dict)
    by_target_id: Mapping[str, str] = field(default_factory=dict)
    tags: Sequence[str] = ()
    mirror_source_id: str = "37"


# ------------------------------------------------------------------ opening files


def find_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Sorted paths below ``folder`` that match; contents are not read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(folder).select("path"))
    return sorted({r["path"] for r in found.collect()})


def _first_rows(n: int) -> Column:
    """True for the first ``n`` rows of a single-file scan.

    A scan's first partition starts with the block at offset 0, and the running id
    counts its rows from 0.
    """
    return (F.col("_metadata.file_block_start") == 0) & (F.monotonically_increasing_id() < n)


def open_csv(spark: SparkSession, path: str, skip_after_header: int) -> DataFrame:
    """Header on the first line; the next ``skip_after_header`` lines are dropped."""
    raw = spark.read.option("header", True).csv(path)
    kept = raw.withColumn("_skip", _first_rows(skip_after_header)).filter("NOT _skip").drop("_skip")
    return kept.toDF(*[c.strip() for c in kept.columns])


def _lines(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    text = spark.read.text(path)
    header = text.limit(1).collect()
    body = text.withColumn("_skip", _first_rows(1)).filter("NOT _skip").drop("_skip")
    return (header[0]["value"] if header else ""), body


def open_tsv(spark: SparkSession, path: str, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Only the wanted columns, each found by the first header that contains one of its
    names; lines with more fields than the header are skipped."""
    header, body = _lines(spark, path)
    names = header.split("\t")
    fields = body.select(F.split("value", "\t", -1).alias("f")).filter(F.size("f") <= len(names))
    out = []
    for alias, spellings in wanted.items():
        at = next((i for s in spellings for i, n in enumerate(names) if s in n), None)
        text = F.try_element_at("f", F.lit(at + 1)) if at is not None else F.lit(None).cast("string")
        out.append(F.nullif(F.trim(text), F.lit("")).alias(alias))
    return fields.select(*out)


def repair_header(header: str) -> list[str]:
    """Column names of a tab-separated quoted header whose separators were lost in places."""
    fixed = re.sub(r'""(?=[A-Z])', '"\t"', header)
    return [n.strip().strip('"').strip() for n in fixed.split("\t")]


def open_quoted_tsv(spark: SparkSession, path: str) -> DataFrame:
    header, body = _lines(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in repair_header(header)])
    ddl = ", ".join(f"`{f.name}` STRING" for f in schema.fields)
    return body.select(F.from_csv("value", ddl, {"sep": "\t", "quote": '"'}).alias("r")).select("r.*")


def tolerant(read):
    """Result of ``read()``, or None when the path or schema cannot be resolved."""
    try:
        return read()
    except AnalysisException:
        return None


# ------------------------------------------------------------------ parsers


def _has(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _text(df: DataFrame, *names: str) -> Column:
    for name in names:
        if name in df.columns:
            return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit(""))
    return F.lit("")


def _containing(df: DataFrame, part: str) -> Column:
    name = next((c for c in df.columns if part in c.lower()), None)
    return F.col(f"`{name}`") if name else F.lit(None).cast("string")


def _number(c: Column) -> Column:
    return X.nan_to_null(c.try_cast("double"))


def _rows(df: DataFrame, source: str, assay: str, filename: str, assay_type: str, **cols: Column) -> DataFrame:
    """Fill the measurement contract; what a format does not carry stays empty."""
    blank = {"doi": F.lit(""), "pmid": F.lit(""), "bioassay_name": F.lit(""), "raw_unit_string": F.lit(""),
             "has_dose_response": F.lit(False), "is_artifact_high": F.lit(False), "is_artifact_low": F.lit(False)}
    fixed = {"source_db": F.lit(source), "source_id": F.lit(assay), "assay_id": F.lit(assay),
             "source_file": F.lit(filename), "assay_type": F.lit(assay_type)}
    all_cols = {**blank, **fixed, **cols}
    kept = df.filter(F.coalesce(F.trim(cols["raw_smiles"]), F.lit("")) != "") if "raw_smiles" in cols else df
    return kept.select(*[
        all_cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MEASUREMENT.fields])


SMILES = "PUBCHEM_EXT_DATASOURCE_SMILES"


def _accession_target(accession: Column, targets: Targets, default: Column) -> Column:
    exact = X.lookup(accession, targets.by_accession) if targets.by_accession else F.lit(None).cast("string")
    rules = [(accession.contains(k), v) for k, v in targets.by_accession.items()]
    return F.coalesce(exact, X.first_rule(rules) if rules else F.lit(None).cast("string"), default)


def parse_mirrored(df: DataFrame, targets: Targets, **where) -> DataFrame:
    """Format A: nanomolar values as they are, else the second value column x 1000."""
    unit, kind = F.lower(_text(df, "Standard Units")), F.lower(_text(df, "Standard Type"))
    std, alt = _number(_has(df, "Standard Value")), _number(_has(df, "PubChem Standard Value"))
    direct = (unit == "nm") & std.isNotNull()
    nm = F.when(direct, std).when(alt.isNotNull(), alt * 1000)
    sign = _text(df, "Standard Relation")
    return _rows(
        df.filter(nm > 0), "PubChem", raw_smiles=F.col(SMILES), activity_value_nM=nm,
        original_activity_value=F.when(direct, std).otherwise(alt), original_unit=F.when(direct, "nM").otherwise("µM"),
        unit_conversion_factor=F.when(direct, 1).otherwise(1000), qualifier=F.when(sign == "", "=").otherwise(sign),
        measurement_type=X.first_rule([(kind.contains("ic50"), "IC50"), (kind.contains("ki"), "Ki")], F.upper(kind)),
        target_isoform=F.lit(targets.main_name), target_uniprot=F.lit(targets.main_accession),
        doi=_text(df, "DOI", "doi"), pmid=_text(df, "PMID", "pmid"), bioassay_name=_text(df, "BioAssay Name", "Assay Name"),
        raw_unit_string=F.when(direct, unit).otherwise("µM"), **where)


def parse_dose_response(df: DataFrame, targets: Targets, **where) -> DataFrame:
    """Format B: records of the main accession with an IC50 and a whitelisted qualifier."""
    if "Target Accession(s)" in df.columns:
        df = df.filter(_text(df, "Target Accession(s)").contains(targets.main_accession))
        accession = _text(df, "Target Accession(s)")
    else:
        accession = F.lit(targets.main_accession)
    nm = _number(_has(df, "IC50"))
    sign = F.trim(F.replace(_text(df, "IC50 Qualifier", "Standard Relation"), F.lit(".0"), F.lit("")))
    curve = _text(df, "Curve Class")
    dose = ~F.lower(_text(df, "Has Dose Response")).isin("", "false", "0", "nan") | ~curve.isin("", "nan")
    return _rows(
        df.filter(nm > 0), "PubChem", raw_smiles=F.col(SMILES), activity_value_nM=nm, original_activity_value=nm,
        original_unit=F.lit("nM"), unit_conversion_factor=F.lit(1), qualifier=X.normal_qualifier(sign), measurement_type=F.lit("IC50"),
        target_isoform=F.coalesce(X.lookup(accession, targets.by_accession), F.lit(targets.main_name)) if targets.by_accession else F.lit(targets.main_name),
        target_uniprot=accession, doi=_text(df, "DOI"), pmid=_text(df, "PMID"), has_dose_response=dose,
        bioassay_name=_text(df, "BioAssay Name"), screening_concentration_uM=_number(_containing(df, "conc")),
        raw_unit_string=F.lit("nM"), **where)


def parse_first_of(df: DataFrame, targets: Targets, **where) -> DataFrame:
    """Format C: Ki where it parses, else IC50; a non-positive first value drops the row."""
    ki, ic50 = _number(_has(df, "Ki")), _number(_has(df, "IC50"))
    nm = F.coalesce(ki, ic50)
    accession = _text(df, "Target Accession(s)")
    return _rows(
        df.filter(nm > 0), "PubChem", raw_smiles=F.col(SMILES), activity_value_nM=nm, original_activity_value=nm,
        original_unit=F.lit("nM"), unit_conversion_factor=F.lit(1), qualifier=F.lit("="),
        measurement_type=F.when(ki.isNotNull(), "Ki").otherwise("IC50"),
        target_isoform=_accession_target(accession, targets, F.lit(targets.main_name)), target_uniprot=accession,
        raw_unit_string=F.lit("nM"), **where)


def _inhibition(df: DataFrame) -> Column:
    return _number(_containing(df, "inhibition"))


def _percent(df: DataFrame, raw: Column, **cols) -> DataFrame:
    return _rows(
        df.filter(F.abs(raw) >= K.SCREEN_MIN_INFORMATIVE), "PubChem", raw_smiles=F.col(SMILES), original_activity_value=raw,
        original_unit=F.lit("%"), unit_conversion_factor=F.lit(1), qualifier=F.lit("="), measurement_type=F.lit("pct_inhibition"),
        pct_inhibition=X.clip(raw, 0.0, 100.0), is_artifact_high=raw > 100, is_artifact_low=raw < 0, **cols)


def parse_screen(df: DataFrame, targets: Targets, **where) -> DataFrame:
    """Format D: percent inhibition, small readings dropped, clipped with artefact flags."""
    return _percent(df, _inhibition(df), target_isoform=F.lit(targets.main_name), target_uniprot=F.lit(targets.main_accession),
                    screening_concentration_uM=_number(_containing(df, "conc")), **where)


def parse_panel(df: DataFrame, targets: Targets, **where) -> DataFrame:
    """Format E: the target is found by accession in the panel target, then by tag in its name."""
    panel, target = _text(df, "Panel Name"), _text(df, "Panel Target")
    rules = [(target.contains(k), v) for k, v in targets.by_accession.items()] + [(panel.contains(tag), tag) for tag in targets.tags]
    name = X.first_rule(rules) if rules else F.lit(None).cast("string")
    return _percent(df.filter(name.isNotNull()), _inhibition(df), target_isoform=name, target_uniprot=target, **where)


def parse_micromolar(df: DataFrame, targets: Targets, **where) -> DataFrame:
    """Format F: averages and deviations in micromolar, both x 1000."""
    um = _number(_has(df, "Average IC50"))
    return _rows(
        df.filter(um > 0), "PubChem", raw_smiles=F.col(SMILES), activity_value_nM=um * 1000, original_activity_value=um,
        original_unit=F.lit("µM"), unit_conversion_factor=F.lit(1000), qualifier=X.normal_qualifier(_text(df, "Qualifier")),
        measurement_type=F.lit("IC50"), target_isoform=F.lit(targets.main_name), target_uniprot=F.lit(targets.main_accession),
        sd_reported=_number(_has(df, "Standard Deviation")) * 1000, doi=_text(df, "DOI"), pmid=_text(df, "PMID"),
        bioassay_name=_text(df, "BioAssay Name"), raw_unit_string=F.lit("µM"), **where)


BINDING_COLUMNS = {
    "smiles": ["Ligand SMILES"], "Ki": ["Ki (nM)"], "IC50": ["IC50 (nM)"],
    "accession": ["UniProt (SwissProt) Primary ID of Target Chain 1"], "doi": ["Article DOI", "DOI"], "pmid": ["PMID", "PubMed ID"]}


def parse_binding(df: DataFrame, targets: Targets, hint: str | None, **where) -> DataFrame:
    """One row per reported IC50 and Ki; comparison signs are split off the number."""
    keep = [c for c in df.columns if c not in ("IC50", "Ki")]
    long = df.unpivot(keep, ["IC50", "Ki"], "kind", "text").filter(F.col("text").isNotNull())
    sign, nm = X.split_qualifier(F.col("text"))
    accession = F.coalesce("accession", F.lit(""))
    target = F.coalesce(X.lookup(accession, targets.by_accession), F.lit(hint), F.lit(targets.main_name)) if targets.by_accession else F.lit(hint or targets.main_name)
    return _rows(
        long.filter(nm > 0), "BindingDB", raw_smiles=F.col("smiles"), activity_value_nM=nm, original_activity_value=nm,
        original_unit=F.lit("nM"), unit_conversion_factor=F.lit(1), qualifier=sign, measurement_type=F.col("kind"),
        target_isoform=target, target_uniprot=accession, doi=F.coalesce("doi", F.lit("")), pmid=F.coalesce("pmid", F.lit("")),
        raw_unit_string=F.lit("nM"), **where)


def parse_chembl(df: DataFrame, targets: Targets, hint: str | None, **where) -> DataFrame:
    """IC50 and Ki in nanomolar; records mirrored from the assay archive are dropped."""
    bare = lambda *n: F.trim(F.regexp_replace(_text(df, *n), "^'+|'+$", ""))
    kind, nm, tid = bare("Standard Type"), _number(bare("Standard Value")), bare("Target ChEMBL ID")
    kept = df.filter(kind.isin("IC50", "Ki") & (F.lower(bare("Standard Units")) == "nm")
                     & (bare("Source ID") != targets.mirror_source_id) & (nm > 0))
    target = F.coalesce(X.lookup(tid, targets.by_target_id), F.lit(hint), F.lit(targets.main_name)) if targets.by_target_id else F.lit(hint or targets.main_name)
    return _rows(
        kept, "ChEMBL", raw_smiles=F.col("Smiles"), activity_value_nM=nm, original_activity_value=nm, original_unit=F.lit("nM"),
        unit_conversion_factor=F.lit(1), qualifier=X.normal_qualifier(bare("Standard Relation")), measurement_type=kind,
        target_isoform=target, target_uniprot=tid, doi=_text(df, "DOI", "Document DOI"), pmid=_text(df, "PMID", "Pubmed ID"),
        bioassay_name=_text(df, "Assay Description"), raw_unit_string=F.lit("nM"), **where)


# Format letter to parser and to the number of metadata lines under the header.
PARSERS = {"A": (parse_mirrored, 5), "B": (parse_dose_response, 5), "C": (parse_first_of, 4),
           "D": (parse_screen, 4), "E": (parse_panel, 4), "F": (parse_micromolar, 5)}


def load_measurements(
    spark: SparkSession, folder: str, formats: Mapping[str, str], assay_types: Mapping[str, str], targets: Targets,
    assay_glob: str = "AID_*_datatable_all.csv", binding_glob: str = "BindingDB_*.tsv", chembl_glob: str = "CHEMBL_*.tsv",
) -> DataFrame:
    """Every known file below ``folder`` as one measurement table.

    ``formats`` maps assay id to format letter; unknown assays are skipped.
    """
    default_type = "biochemical_single_point"
    parts = []
    for path in find_files(spark, folder, assay_glob):
        name = path.rsplit("/", 1)[-1]
        assay = name.replace("_datatable_all.csv", "")
        if formats.get(assay) in PARSERS:
            parse, skip = PARSERS[formats[assay]]
            parts.append(parse(open_csv(spark, path, skip), targets, assay=assay, filename=name,
                               assay_type=assay_types.get(assay, default_type)))
    for glob, opener, parse in (
        (binding_glob, lambda p: open_tsv(spark, p, BINDING_COLUMNS), parse_binding),
        (chembl_glob, lambda p: open_quoted_tsv(spark, p), parse_chembl),
    ):
        for path in find_files(spark, folder, glob):
            name = path.rsplit("/", 1)[-1]
            assay = name.replace(".tsv", "")
            hint = next((tag for tag in targets.tags if tag in name), None)
            parts.append(parse(opener(path), targets, hint, assay=assay, filename=name, assay_type=assay_types.get(assay, default_type)))
    if not parts:
        raise RuntimeError(f"no known measurement files below {folder}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def ingest_manifest(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("source_file", "source_db").agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------------ derived files


def read_split(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Train, val and test CSV of a split folder: the locked test wins, an empty val is left out."""
    read = lambda name: tolerant(lambda: spark.read.option("header", True).csv(f"{folder}/{name}.csv"))
    found = {"train": read("train"), "val": read("val"), "test": read("test_locked")}
    found["test"] = found["test"] if found["test"] is not None else read("test")
    if found["val"] is not None and found["val"].isEmpty():
        found["val"] = None
    return {k: v for k, v in found.items() if v is not None}


def flatten(df: DataFrame, joiner: str = "_") -> DataFrame:
    """Struct columns as ``outer_inner`` columns, at any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        cols = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{joiner}{g.name}") for g in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def read_metric_cells(spark: SparkSession, folder: str, levels: Sequence[str], glob: str = "metrics.json") -> DataFrame:
    """Nested metric documents of a result tree as flat rows; path parts name the cell."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).json(folder)
           .withColumn("_path", F.split(F.col("_metadata.file_path"), "/")))
    keyed = raw
    for i, level in enumerate(reversed(list(levels))):
        keyed = keyed.withColumn(level, F.element_at("_path", F.lit(-2 - i)))
    flat = flatten(keyed.drop("_path"))
    rest = sorted(c for c in flat.columns if c not in levels)
    return flat.select(*levels, *rest)


def raw_inventory(spark: SparkSession, folder: str, roles: Mapping[str, str], glob: str = "*") -> DataFrame:
    """Per raw file: bytes, SHA-256, exact line count, header, role."""
    reader = lambda fmt: spark.read.format(fmt).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    files = reader("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    text = reader("text").load(folder).select("value", F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_block_start").alias("start"),
                                              F.monotonically_increasing_id().alias("at"))
    lines = text.groupBy("filename").agg(
        F.count(F.lit(1)).alias("lines"), F.min_by("value", F.struct("start", "at")).alias("header"))
    role = X.first_rule([(F.col("filename").contains(k), v) for k, v in roles.items()], "?") if roles else F.lit("?")
    return files.join(lines, "filename", "left").withColumn("role", role)
