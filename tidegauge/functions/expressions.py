"""Row-level derivations as plain column expressions (all stay in codegen)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as K


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def yes(condition: Column) -> Column:
    """A stored or negated condition: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def lookup(key: Column, table: Mapping[str, float | str], default=None) -> Column:
    """Small fixed mapping as one CASE; no join, no shuffle."""
    branch = None
    for name, value in table.items():
        branch = (F if branch is None else branch).when(key == F.lit(name), F.lit(value))
    return branch.otherwise(F.lit(default))


def first_rule(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """First matching rule wins."""
    branch = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        branch = (F if branch is None else branch).when(condition, value)
    return branch.otherwise(default if isinstance(default, Column) else F.lit(default))


def last_rule(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Overwriting masks: the last matching rule wins."""
    return first_rule(list(reversed(rules)), default)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def true_count(*conditions: Column) -> Column:
    total = F.lit(0)
    for condition in conditions:
        total = total + yes(condition).cast("int")
    return total


def first_existing(df: DataFrame, names: Sequence[str], default=None) -> Column:
    """First non-null among the named columns that the frame really has."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(default)) if present else F.lit(default)


def safe_double(text: Column, default: float | None = None) -> Column:
    """Tolerant number: unparsable or non-finite text becomes ``default``."""
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(finite, number).otherwise(F.lit(default).cast("double"))


def split_qualifier(text: Column) -> tuple[Column, Column]:
    """``'>= 12.5'`` to qualifier ``'>='`` and number 12.5; bare numbers give ``'='``."""
    trimmed = F.trim(text)
    sign = F.regexp_extract(trimmed, r"^(>=|<=|>|<)", 1)
    number = F.trim(F.regexp_replace(trimmed, r"^(>=|<=|>|<)", "")).try_cast("double")
    return F.when(sign != "", sign).otherwise(F.lit("=")), number


def normal_qualifier(raw: Column) -> Column:
    cleaned = F.trim(raw)
    return F.when(cleaned.isin(K.QUALIFIERS), cleaned).otherwise(F.lit("="))


def log_activity(value_nm: Column) -> Column:
    return F.when(value_nm > 0, F.lit(9.0) - F.log10(value_nm))


def exact_activity(value_nm: Column, qualifier: Column, kind: Column) -> Column:
    return F.when((qualifier == "=") & kind.isin("IC50", "Ki"), log_activity(value_nm))


def censored_bounds(value_nm: Column, qualifier: Column) -> dict[str, Column]:
    """Open bounds of censored values; ``>`` bounds the log activity from above."""
    above = qualifier.isin(">", ">=") & (value_nm > 0)
    below = qualifier.isin("<", "<=") & (value_nm > 0)
    return {
        "activity_upper": F.when(above, log_activity(value_nm)),
        "activity_lower": F.when(below, log_activity(value_nm)),
        "lower_bound_nm": F.when(above, value_nm).when(below, F.lit(0.0)),
        "upper_bound_nm": F.when(above, F.lit(float("inf"))).when(below, value_nm),
    }


def in_activity_range(activity: Column) -> Column:
    return yes(activity.between(K.ACTIVITY_LOW, K.ACTIVITY_HIGH))


def with_unit(df: DataFrame, raw: Column, value_nm: Column) -> DataFrame:
    """Add ``unit``, ``unit_confidence`` and ``unit_flag`` (ok / inferred / suspicious / unknown).

    The earliest spelling that equals the text, with or without ``molar``, wins: the first
    one of those equal without it.  The few spellings are a joined table, so a filter on a
    later column reads what was found and does not repeat the search in every branch.
    """
    found: dict[str, str] = {}
    for s in K.UNIT_FACTORS:
        found.setdefault(s.replace("molar", ""), s)
    lines = ", ".join(f"('{k}', '{s}', {float(K.UNIT_CONFIDENCE.get(s, K.UNIT_CONFIDENCE_DEFAULT))!r}D)" for k, s in found.items())
    table = df.sparkSession.sql(f"SELECT * FROM VALUES {lines} AS t(_bare, _unit, _confidence)")
    clean = F.replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit(" "), F.lit(""))
    named = df.withColumn("_clean", clean).withColumn("_bare", F.replace(F.col("_clean"), F.lit("molar"), F.lit("")))
    joined = named.join(F.broadcast(table), "_bare", "left")
    blank = F.col("_clean").isin("", "nan", "none", "unknown")
    near, far = yes(value_nm.between(0.001, 1e6)), yes(~value_nm.between(0.001, 1e7))
    unit, confidence = F.col("_unit"), F.col("_confidence")
    inferred, unknown = (F.lit(float(K.UNIT_CONFIDENCE[k])) for k in ("inferred_nm", "unknown"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("unit", "unit_confidence", "unit_flag")],
        first_rule([(blank & near, "inferred_nm"), (blank | unit.isNull(), "unknown")], unit).alias("unit"),
        first_rule([(blank & near, inferred), (blank | unit.isNull(), unknown),
                    ((unit == "nm") & far, F.least(confidence, F.lit(0.5)))], confidence).alias("unit_confidence"),
        first_rule([(blank & near, "inferred"), (blank | unit.isNull(), "unknown"), (far, "suspicious")], "ok").alias("unit_flag"))


def time_dependence(text: Column) -> Column:
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in K.TIME_DEPENDENCE_PATTERNS)
    return yes(text.rlike(pattern))


def assay_context(
    category: Column, name: Column, dose_response: Column, doi: Column, pmid: Column, human: Column
) -> dict[str, Column]:
    """Assay type and context score: base by category plus ordered additive rules."""
    title, kind = F.lower(F.coalesce(name, F.lit(""))), F.lower(category)
    d = K.CONTEXT_DELTAS
    confirm = contains_any(title, K.CONFIRMATORY_WORDS) | contains_any(kind, K.CONFIRMATORY_WORDS)
    steps = [
        (confirm, "confirmatory", d["is_biochemical"]),
        (contains_any(title, K.BIOCHEMICAL_WORDS), "biochemical", d["is_biochemical"]),
        (contains_any(title, K.CELL_WORDS), "cell-based", d["is_cell_based"]),
        (kind.contains("hts") | kind.contains("percent_inhibition"), "HTS", d["is_hts_penalty"]),
        (contains_any(title, K.RNAI_WORDS), "HTS", d["is_rnai"]),
    ]
    held = lambda c: yes(~F.trim(c).isin("", "nan", "None"))
    base = lookup(category, K.ASSAY_CONFIDENCE, K.ASSAY_CONFIDENCE["unknown"])
    total = (
        base
        + F.when(yes(dose_response), d["has_dose_response"]).otherwise(0.0)
        + F.when(held(doi), d["has_doi"]).when(held(pmid), d["has_pmid"]).otherwise(0.0)
        + first_rule([(c, delta) for c, _, delta in steps], 0.0)
        + F.when(yes(human), 0.0).otherwise(d["is_non_human"])
    )
    return {
        "assay_type": first_rule([(c, label) for c, label, _ in steps], "unknown"),
        "context_score": clip(total, 0.05, 1.0),
        "literature_confidence": F.when(held(doi), 1.0).when(held(pmid), 0.6).otherwise(0.0),
    }


def tier(
    kind: Column, qualifier: Column, value_nm: Column, activity: Column,
    passed: Column, is_mouse: Column, unit_flag: Column,
) -> Column:
    """Ki apart; percentages T3; censored T2; clean exact values T1; rest T3."""
    usable = (kind == "IC50") & (value_nm > 0) & passed & ~is_mouse
    return first_rule(
        [
            (kind == "Ki", "Ki"),
            (kind == "pct_inhibition", "T3"),
            (usable & (qualifier != "="), "T2"),
            (
                usable & (qualifier == "=") & in_activity_range(activity)
                & unit_flag.isin("ok", "inferred"),
                "T1",
            ),
        ],
        "T3",
    )


def replicate_weight(
    assay_confidence: Column, source_db: Column, sd: Column, value_nm: Column, unit_confidence: Column
) -> Column:
    either = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    noise = F.when(
        (sd > 0) & (value_nm > 0), F.least(sd / (F.log(F.lit(10.0)) * value_nm), F.lit(1.0))
    ).otherwise(0.0)
    reliability = lookup(source_db, K.SOURCE_RELIABILITY, K.SOURCE_RELIABILITY_DEFAULT)
    raw = either(assay_confidence, 0.5) * reliability * (1 - noise) * either(unit_confidence, 0.8)
    return clip(raw, 1e-6, 1.0)


def label_uncertainty(std: Column, assay: Column, source: Column, unit: Column, context: Column) -> Column:
    w = K.UNCERTAINTY_WEIGHTS
    gap = lambda c, d: clip(1.0 - F.coalesce(c, F.lit(d)), 0.0, 1.0)
    return (
        w["std"] * clip(F.coalesce(std, F.lit(0.0)), 0.0, 1.0)
        + w["assay"] * gap(assay, 0.5)
        + w["source"] * gap(source, 0.6)
        + w["unit"] * gap(unit, 0.8)
        + w["context"] * gap(context, 0.5)
    )


def fidelity_level(n: Column, std: Column, uncertainty: Column) -> Column:
    tight = std <= K.HIGH_VARIANCE_STD
    return first_rule(
        [((n >= 3) & tight & (uncertainty < 0.15), "T1_high"), ((n >= 2) & tight, "T1_confirmed")],
        "T1_standard",
    )


def interval_class(lower: Column, upper: Column) -> Column:
    """1 above the threshold for sure, 0 below for sure, else unknown."""
    return F.when(upper < K.ACTIVE_FROM, 0).when(lower > K.ACTIVE_FROM, 1)


def severity(delta: Column) -> Column:
    return first_rule([(delta >= cut, name) for name, cut in K.CLIFF_SEVERITY], "none")


def seeded_hash(key: Column, seed: int) -> Column:
    """52-bit number from the key alone, so order never depends on partitioning."""
    text = F.concat_ws("|", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def seeded_uniform(key: Column, seed: int) -> Column:
    """Uniform in (0, 1) from the key alone."""
    return (seeded_hash(key, seed).cast("double") + 0.5) / F.lit(float(2**52))
