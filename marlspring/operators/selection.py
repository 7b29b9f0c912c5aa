"""Strict risk assessment of candidates, and the selection of the best of them.

What a row gains for a gap in the categories depends on the rows accepted before it. Whether a row is accepted does
not depend on the gain, so a category is open to a row exactly if no accepted row stands before it:
one minimum for each hinted category replaces the walk over all rows, and its table has a row a hint.

Defined results: null texts and lists count as empty; rows of one place in the order are open to the same categories; equal
scores are ordered by the keys stated; an empty table gives no rows; extra columns of candidates are kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspring.functions.scalars import strip


class Standard(NamedTuple):
    """What a selection asks for: terms of titles with their risks, terms that anchor a title, hinted categories, tags with their risks."""

    hard: dict[str, str]
    soft: dict[str, str]
    core: list[str]
    hints: dict[str, str]
    hard_tags: dict[str, str]
    #: Tag that is a risk only with one of these terms in the title.
    tag_terms: dict[str, tuple[str, list[str]]]
    #: Soft risks that leave a candidate in reserve.
    reserve: list[str]


#: The survey's standard.
CORE = Standard(
    hard={
        "mars": "mars_or_martian_boundary", "martian": "mars_or_martian_boundary", "comet": "comet_boundary", "67p": "comet_boundary",
        "witness coupon": "curation_or_witness_coupon_supporting", "sample return": "curation_or_witness_coupon_supporting",
        "curation": "curation_or_witness_coupon_supporting", "contamination": "curation_or_witness_coupon_supporting", "survivability": "survivability_boundary",
    },
    soft={
        "interstellar": "analog_or_interstellar_boundary", "analog": "analog_or_interstellar_boundary", "analogue": "analog_or_interstellar_boundary",
        "nitrogen-rich ices": "analog_or_interstellar_boundary", "model compounds": "model_compound_boundary", "review": "broad_review_or_record",
        "record": "broad_review_or_record", "history": "broad_review_or_record", "composition": "broad_review_or_record", "biogenicity": "broad_review_or_record",
        "perspective": "broad_review_or_record", "biosignature": "broad_detection_or_scope_boundary", "microscopy": "broad_detection_or_scope_boundary",
        "detection of extraterrestrial life": "broad_detection_or_scope_boundary", "ceres": "non_sample_body_scope_boundary", "comment": "commentary_or_reply", "reply": "commentary_or_reply",
    },
    core=["meteorite", "micrometeorite", "chondrite", "carbonaceous", "ryugu", "bennu", "asteroid", "extraterrestrial"],
    hints={
        "amino_acids": "amino-acid-heavy extraterrestrial samples", "carboxylic_acids": "carboxylic-acid coverage", "amines": "amine / aliphatic amine coverage", "pahs": "PAH-rich samples",
        "sugars": "sugar-rich meteoritic organics", "organic_matter": "organic matter / alteration interaction papers",
        "analytical_methods": "direct sample analytics with interpretable evidence", "volatile_organics": "volatile organic compound coverage",
    },
    hard_tags={"martian_sample": "mars_or_martian_boundary"},
    tag_terms={"contamination_qc": ("curation_or_witness_coupon_supporting", ["sample return", "curation", "witness coupon", "contamination"])},
    reserve=["analog_or_interstellar_boundary", "model_compound_boundary", "broad_review_or_record", "broad_detection_or_scope_boundary", "weak_sample_anchor", "non_sample_body_scope_boundary"],
)
MISSING, WEAK = "missing_clear_organic_projection", "weak_sample_anchor"


def plain_lower(c: Column) -> Column:
    """White space collapsed, trimmed, lower case; null is empty."""
    return F.lower(strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")))


def parts(c: Column) -> Column:
    """The non-empty parts between semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), ";"), strip), lambda x: x != "")


def _risks(title: Column, terms: dict[str, str]) -> list[Column]:
    return [F.when(title.contains(t), F.lit(label)) for t, label in terms.items()]


def assess(rows: DataFrame, order: list[str], standard: Standard = CORE) -> DataFrame:
    """Adds hard, soft (risks), gaps (hinted categories still open), include, likelihood, scope_risk and score.

    rows: doc_name, candidate_tags and projected (parts between semicolons), name, organic_snippet, name_snippet, section_hints,
    recommendation, review_priority, priority_score. ``order`` is the order in which candidates are accepted.
    """
    title, tags = plain_lower(F.col("doc_name")), parts(F.col("candidate_tags"))
    hard = _risks(title, standard.hard) + [F.when(F.array_contains(tags, t), F.lit(label)) for t, label in standard.hard_tags.items()]
    for tag, (label, terms) in standard.tag_terms.items():
        hard.append(F.when(F.array_contains(tags, tag) & title.rlike("|".join(rf"\Q{t}\E" for t in terms)), F.lit(label)))
    n = F.size(parts(F.col("projected")))
    named = plain_lower(F.col("name")) != ""
    anchored = named | title.rlike("|".join(rf"\Q{t}\E" for t in standard.core))
    distinct = lambda cols: F.array_sort(F.array_distinct(F.array_compact(F.array(*cols))))
    step = rows.withColumns({
        "hard": distinct([*hard, F.when(n == 0, F.lit(MISSING))]), "soft": distinct([*_risks(title, standard.soft), F.when(~anchored, F.lit(WEAK))]),
        "_tags": tags, "_n": n, "_anchored": anchored,
    })
    clean, reserve = F.size("hard") == 0, F.exists("soft", lambda x: x.isin(standard.reserve))
    likelihood = (
        F.when(clean & (F.size("soft") == 0) & F.col("_anchored") & (F.col("_n") >= 2), "recommended_core_now")
        .when(clean & F.col("_anchored") & (F.col("_n") >= 1) & ~reserve, "backup_after_scope_check")
        .when(clean & (F.col("_n") >= 1) & reserve, "reserve_not_recommended_first")
        .otherwise("excluded")
    )
    step = step.withColumn("likelihood", likelihood).withColumn("include", F.col("likelihood") != "excluded")
    place = F.struct(*order)
    hinted = F.array(*[F.lit(t) for t in standard.hints])
    first = step.where("include").select(F.explode(F.array_intersect("_tags", hinted)).alias("tag"), place.alias("p")).groupBy("tag").agg(F.min("p").alias("p"))
    # One row, with an entry for each hint at most.
    opened = first.agg(F.map_from_entries(F.collect_list(F.struct("tag", "p"))).alias("_first"))
    step = step.crossJoin(F.broadcast(opened))
    still = F.filter("_tags", lambda t: t.isin(list(standard.hints)) & (F.col("_first")[t].isNull() | (place <= F.col("_first")[t])))
    step = step.withColumn("gaps", still)
    has = lambda c: plain_lower(F.col(c)) != ""
    section = F.coalesce(F.col("section_hints").contains("results_or_analytical") | F.col("section_hints").contains("table_or_caption"), F.lit(False))
    evidence = (
        F.when(has("name"), 2).otherwise(0) + F.when(F.col("_n") >= 3, 2).when(F.col("_n") >= 1, 1).otherwise(0) + F.when(has("organic_snippet"), 2).otherwise(0)
        + F.when(has("name_snippet"), 1).otherwise(0) + F.when(section, 1).otherwise(0)
    )
    score = (
        F.coalesce(F.col("priority_score"), F.lit(0)) + evidence + F.least(F.lit(3), F.size("gaps"))
        + F.when(F.coalesce(F.col("recommendation").contains("likely_core_gold"), F.lit(False)), 3).otherwise(0)
        + F.when(F.col("review_priority") == "high", 3).when(F.col("review_priority") == "medium", 1).otherwise(0)
        - F.when(F.size("hard") > 0, 100).otherwise(0) - 10 * F.size("soft")
    )
    scope = (
        F.when(F.col("likelihood") == "recommended_core_now", "low_scope_risk")
        .when(F.col("likelihood") == "backup_after_scope_check", F.when(F.size("soft") > 0, "medium_scope_risk").otherwise("low_scope_risk"))
        .when(F.col("likelihood") == "reserve_not_recommended_first", "elevated_scope_risk")
        .when(F.size("hard") + F.size("soft") > 0, F.array_join(F.array_sort(F.array_distinct(F.concat("hard", "soft"))), "; "))
        .otherwise("excluded")
    )
    return step.withColumn("score", score.cast("long")).withColumn("scope_risk", scope).drop("_tags", "_n", "_anchored", "_first")


#: How likelihoods and scope risks rank among equal scores.
LIKELIHOOD = {"recommended_core_now": 3, "backup_after_scope_check": 2, "reserve_not_recommended_first": 1}
SCOPE = {"low_scope_risk": 3, "medium_scope_risk": 2, "elevated_scope_risk": 1}


def select_core(assessed: DataFrame, limit: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(the best ``limit`` accepted rows with their rank, the others with a reason), without others that share a selected row's title.

    Accepted rows beyond the limit have the reason ``reserve_overflow_after_limit``. Ties are broken by likelihood, scope risk and the least key.
    The best are a top-n of Spark, so its size is the limit's.
    """
    rank = lambda c, of: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in of.items()], F.lit(0))
    title = F.regexp_replace(plain_lower(F.col("doc_name")), "[^a-z0-9]+", " ")
    rows = assessed.withColumns({"_l": rank("likelihood", LIKELIHOOD), "_s": rank("scope_risk", SCOPE), "_title": strip(title)})
    by = [F.desc("score"), F.desc("_l"), F.desc("_s"), F.asc(key)]
    best = rows.where("include").orderBy(*by).limit(limit)
    chosen = best.select(F.col(key).alias("_key"), F.col("_title").alias("_chosen"))
    # The selected rows are ``limit`` at most; their keys and titles are the only thing that is sent around.
    rest = rows.join(F.broadcast(chosen.select("_key")), F.col(key) == F.col("_key"), "left_anti")
    rest = rest.join(F.broadcast(chosen.select("_chosen").where("_chosen <> ''")), F.col("_title") == F.col("_chosen"), "left_anti")
    reason = F.when(F.col("include"), "reserve_overflow_after_limit").otherwise(F.col("scope_risk"))
    return best.drop("_l", "_s", "_title"), rest.withColumn("reason", reason).drop("_l", "_s", "_title")
