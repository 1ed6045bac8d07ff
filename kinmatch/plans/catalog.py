"""The registered queries: every operator on the derived people tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scorers, text
from ..operators import audit, calibrate, compare, cosine, coverage, match, near
from ..operators.standardize import standardize
from ..sources import tables
from . import people
from .specs import SPECS, spec_of

Query = Callable[[SparkSession, str], DataFrame]


def _raw(spark, sf_dir):
    return people.people_input(spark, sf_dir), people.master(spark, sf_dir)


def _records(spark, sf_dir):
    a, b = _raw(spark, sf_dir)
    return standardize(a), standardize(b)


def _unicode_parts(spark, sf_dir):
    """House and unit numbers of addresses with digits of another script and a no-break space."""
    digits = "translate(CAST(c_custkey AS STRING), '0123456789', '\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669')"
    made = tables.read_table(spark, f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey", f"concat({digits}, ' MILL ST\u00a0APT\u00a0', CAST(c_nationkey AS STRING), ', X') AS a"
    )
    return made.selectExpr("c_custkey", f"CAST({text.house_number('a')} AS BIGINT) AS house", f"{text.unit_number('a')} AS unit_number")


def _both(spark, sf_dir, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    a, b = _records(spark, sf_dir)
    first, second = (f(df).selectExpr(f"'{side}' AS side", "*") for side, df in (("input", a), ("master", b)))
    return first.unionByName(second)


def _search(df: DataFrame) -> DataFrame:
    entries = ", ".join(f"struct('{s.name}' AS match_type, {s.search_string()} AS search)" for s in SPECS.values())
    return df.selectExpr("row_id", f"inline(array({entries}))")


def _parts(df: DataFrame) -> DataFrame:
    named = df.selectExpr(
        "row_id",
        "FullAddress AS a",
        f"{text.street_name('FullAddress')} AS street",
        f"{text.display_name('First_Name', 'Last_Name')} AS display_name",
    )
    return named.selectExpr(
        "row_id",
        f"CAST({text.house_number('a')} AS BIGINT) AS house",
        "street",
        f"{text.unit_type('a')} AS unit_type",
        f"{text.unit_number('a')} AS unit_number",
        f"{text.replace_all('street', text.MATCH_ABBREVIATIONS)} AS short_street",
        f"{text.replace_all('upper(street)', text.AUDIT_ABBREVIATIONS)} AS audit_street",
        f"{text.third_last_piece('a')} AS third_last",
        f"{text.city_piece('a')} AS city",
        "display_name",
        f"{text.first_word('display_name')} AS first_word",
        f"{text.last_word('display_name')} AS last_word",
    )


def _top_k(match_type: str) -> Query:
    def query(spark, sf_dir):
        found = match.top_k(*_records(spark, sf_dir), spec_of(match_type))
        return found.selectExpr("match_type", "a_id", "b_id", "bround(stage1, 2) AS stage1", "rank")

    return query


def _match(match_type: str, threshold: float | None = None) -> Query:
    def query(spark, sf_dir):
        return match.by_score(match.match(*_records(spark, sf_dir), match_type, threshold))

    return query


def _results(spark, sf_dir) -> DataFrame:
    return match.match_all(*_records(spark, sf_dir))


def _on_results(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_results(spark, sf_dir))


def _partners(spark, sf_dir) -> DataFrame:
    """Every input row next to the master row it was derived from."""
    a, b = _records(spark, sf_dir)
    name = text.display_name("First_Name", "Last_Name")
    left = a.selectExpr(
        "row_id AS pair_id", "FullAddress AS a", f"{name} AS name_a", "row_id * 15 + row_id % 15 AS key"
    )
    right = b.selectExpr("row_id AS key", "FullAddress AS b", f"{name} AS name_b")
    return left.join(right, "key").drop("key")


def _score_pairs(spark, sf_dir):
    scored = match.score_pairs(_partners(spark, sf_dir).select("pair_id", "a", "b"), "a", "b")
    return scored.selectExpr(*(f"bround({c}, 2) AS {c}" if c.endswith("_score") else c for c in scored.columns))


def _unmatched(spark, sf_dir):
    raw, _ = _raw(spark, sf_dir)
    return coverage.unmatched(raw, _results(spark, sf_dir))


def _swept(spark, sf_dir):
    return match.candidates(*_records(spark, sf_dir), thresholds=coverage.LOWER_THRESHOLDS)


def _calibrate(spark, sf_dir):
    label = "IF(pair_id % 10 IN (5, 6, 8, 9), 'BAD', 'GOOD') AS label"
    pairs = _partners(spark, sf_dir).select(F.expr(label), scorers.token_set_ratio("a", "b").alias("score"))
    found = calibrate.calibrate_threshold(pairs)
    return found.selectExpr(*(f"bround({c}, 2) AS {c}" for c in found.columns))


def _expectations(spark, sf_dir):
    label = """CASE WHEN pair_id % 10 IN (5, 6, 8) THEN 'FIXED' WHEN pair_id % 10 = 9 THEN 'LOW'
                    WHEN pair_id % 10 = 7 THEN 'DIFFERENT' WHEN pair_id % 10 IN (2, 3) THEN 'PRESERVE'
                    ELSE 'HIGH' END AS label"""
    return calibrate.check_expectations(
        match.with_address_score(_partners(spark, sf_dir).selectExpr("*", label), "a", "b", "score")
    )


def _roles(spark, sf_dir):
    a, b = _raw(spark, sf_dir)
    found = {"input": a, "master": b}
    input_name, master_name = tables.choose_roles(found)
    counts = coverage.row_counts(**found)
    both = counts.agg(*(F.expr(f"max(IF(table_name = '{n}', rows, NULL)) AS `{n}`") for n in found))
    return both.selectExpr(
        f"'{input_name}' AS input_table",
        f"'{master_name}' AS master_table",
        f"`{input_name}` AS input_rows",
        f"`{master_name}` AS master_rows",
    )


def _cosine(a: str, b: str, configs) -> Query:
    return lambda spark, sf_dir: cosine.cosine_scores(_partners(spark, sf_dir), "pair_id", a, b, configs)


def registered() -> dict[str, Query]:
    queries: dict[str, Query] = {
        "standardize": lambda s, d: _both(s, d, lambda df: df),
        "search_strings": lambda s, d: _both(s, d, _search),
        "address_parts": lambda s, d: _both(s, d, _parts),
    }
    for key, name in (("full_name", "FullName"), ("last_name_address", "LastNameAddress"), ("full_address", "FullAddress")):
        queries[f"top_k_{key}"] = _top_k(name)
        queries[f"match_{key}"] = _match(name)
    queries |= {
        "match_all": _on_results(match.by_score),
        "match_full_address_any_score": _match("FullAddress", 0.0),
        "score_pairs": _score_pairs,
        "unmatched": _unmatched,
        "coverage": lambda s, d: coverage.coverage(_records(s, d)[0], _results(s, d), tuple(SPECS)),
        "unmatched_samples": lambda s, d: coverage.unmatched_samples(_records(s, d)[0], _results(s, d), types=tuple(SPECS)),
        "score_summary": _on_results(lambda r: audit.score_summary(r, tuple(SPECS))),
        "score_distribution": _on_results(audit.score_distribution),
        "below_perfect": _on_results(coverage.below_perfect),
        "lowest_matches": _on_results(coverage.lowest_matches),
        "audit_first": _on_results(lambda r: audit.findings(audit.audit_first(r))),
        "audit_first_summary": _on_results(lambda r: audit.audit_summary(audit.audit_first(r), tuple(SPECS))),
        "audit_revised": _on_results(lambda r: audit.findings(audit.audit_revised(r))),
        "audit_revised_summary": _on_results(lambda r: audit.audit_summary(audit.audit_revised(r), tuple(SPECS))),
        "problem_counts": _on_results(lambda r: audit.problem_counts(audit.findings(audit.audit_first(r)))),
        "problem_samples": _on_results(lambda r: audit.problem_samples(audit.findings(audit.audit_first(r)))),
        "threshold_sweep": lambda s, d: coverage.threshold_sweep(_swept(s, d)),
        "gained_examples": lambda s, d: coverage.gained_examples(_swept(s, d)),
        "calibrate_threshold": _calibrate,
        "check_expectations": _expectations,
        "near_matches": lambda s, d: near.near_matches(*_records(s, d)),
        "near_matches_token_set": lambda s, d: near.near_matches(*_records(s, d), weighted=False),
        "near_match_examples": lambda s, d: near.near_matches(*_records(s, d), limit=20, weighted=False),
        "diff_tables": lambda s, d: compare.diff_tables(*_records(s, d)),
        "diff_summary": lambda s, d: compare.diff_summary(*_records(s, d)),
        "profile_tables": lambda s, d: tables.profile_tables(dict(zip(("input", "master"), _raw(s, d)))),
        "row_counts": lambda s, d: coverage.row_counts(**dict(zip(("input", "master"), _records(s, d)))),
        "table_set": lambda s, d: coverage.row_counts(**tables.read_table_set(s, d)),
        "table_set_by_prefix": lambda s, d: coverage.row_counts(**tables.read_table_set(s, d, only_prefix="c")),
        "row_ids": lambda s, d: tables.with_row_id(tables.read_table(s, f"{d}/customer.parquet")).select("row_id", "c_custkey"),
        "unicode_parts": _unicode_parts,
        "first_rows": lambda s, d: tables.head(_records(s, d)[1]),
        "choose_roles": _roles,
        "unit_patterns": lambda s, d: compare.compare_unit_patterns(_records(s, d)[1], "row_id", "FullAddress"),
        "cosine_address": _cosine("a", "b", (cosine.ADDRESS,)),
        "cosine_name": _cosine("name_a", "name_b", (cosine.NAME,)),
        "cosine_grid": _cosine("a", "b", cosine.GRID),
    }
    return queries
