"""Text, clone, licence and streaming-shaped queries over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import paths
from lodegraph.functions.ranks import half_up
from lodegraph.operators import text

RISKS = {"A": "permissive", "B": "weak-copyleft", "C": "strong-copyleft", "D": "permissive"}


def clones(m):
    """Groups of texts with one normalised token sequence, and how many tokens it has."""
    return text.clone_groups(m.raw("documents").select(F.col("doc_id").alias("file"), "text"), 30)


def table_refs(m):
    """Page links with the host they name, counted."""
    links = m.raw("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("href").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


def tokens(m):
    name = F.concat("p_brand", F.lit("_"), F.initcap("p_name"), F.lit("X"), F.col("p_type"))
    rows = m.raw("part").select(F.explode(paths.name_tokens(name)).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def licenses(m):
    letters = F.transform(F.array("p_size", "p_partkey"), lambda x: F.element_at(F.array(*(F.lit(c) for c in "ABCDE")), (x % 5 + 1).cast("int")))
    both = F.when(F.col("p_partkey") % 3 == 0, F.array_join(letters, " OR ")).otherwise(F.concat(F.lit("("), F.array_join(letters, " AND "), F.lit(")")))
    rows = m.raw("part").select(paths.license_risk(both, RISKS).alias("risk"))
    return rows.groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


TYPES = ("INT(11)", "Serial8", "character  varying ( 20 )", "NUMERIC( 10 , 2 )", "timestamp with time zone", "text[]", "tinyint(1)", "bigint unsigned")
TYPES_OUT = ("integer", "bigint", "varchar(20)", "numeric(10,2)", "timestamptz", "text[]", "tinyint(1)", "bigint unsigned")


def column_types(m):
    raw = F.element_at(F.array(*(F.lit(t) for t in TYPES)), (F.col("p_partkey") % len(TYPES) + 1).cast("int"))
    rows = m.raw("part").select(paths.column_type(raw).alias("type"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def module_depth(m):
    """Implementation lines, interface width and signal of each text as a module."""
    return text.module_depth(m.raw("documents").select(F.col("doc_id").alias("file"), "text"))


def impact_risk(m):
    """Bounded risk score of each part from complexity, reach, signals and tests."""
    rows = m.functions.groupBy("file").agg(
        F.max("decisions").alias("complexity"), F.count_if(F.col("recursive")).alias("signals")
    ).join(m.nodes, F.col("file") == F.col("id"))
    cap = lambda c, top: F.least(F.lit(1.0), F.col(c) / top)
    untested = F.when(F.col("kind") == "test", 0.0).otherwise(1.0)
    score = half_up(100 * (0.4 * cap("complexity", 40) + 0.3 * cap("lines", 50) + 0.2 * cap("signals", 5) + 0.1 * untested))
    band = F.when(score >= 85, "critical").when(score >= 60, "high").when(score >= 30, "moderate").otherwise("low")
    return rows.select("file", score.alias("score"), band.alias("band"))


def sessions(m):
    """Churn of users in windows of a day, as a stream job would add it up."""
    return m.raw("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    ).select(F.to_date("w.start").alias("day"), "event_type", "n", "users")


QUERIES = {
    "x01_clone_groups": (clones, None),
    "x07_link_references": (
        table_refs,
        """with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)
          select href, count(*) as n, count(distinct page_id) as pages from l group by 1""",
    ),
    "x06_name_tokens": (tokens, None),
    "r11_license_risk": (
        licenses,
        """with p as (select p_partkey % 3 = 0 as either, [0, 1, 3, 0, 2][p_size % 5 + 1] as a,
            [0, 1, 3, 0, 2][p_partkey % 5 + 1] as b from part)
          select ['permissive', 'weak-copyleft', 'unknown', 'strong-copyleft'][
            case when either then least(a, b) else greatest(a, b) end + 1] as risk, count(*) as n from p group by 1""",
    ),
    "x08_column_types": (
        column_types,
        f"""select ({list(TYPES_OUT)})[p_partkey % {len(TYPES)} + 1] as type, count(*) as n from part group by 1""",
    ),
    "r07_module_depth": (module_depth, None),
    "r05_impact_risk": (
        impact_risk,
        """with f as (select l_partkey as file, max(cast(round(l_discount * 100) as bigint)) as complexity,
            count(*) filter (l_suppkey % 17 = 0) as signals from lineitem group by 1),
          s as (select file, cast(floor(100 * (0.4::double * least(1.0, complexity / 40.0::double)
            + 0.3::double * least(1.0, p_size / 50.0::double) + 0.2::double * least(1.0, signals / 5.0::double)
            + 0.1::double * case when p_size <= 5 then 0.0::double else 1.0::double end) + 0.5) as bigint) as score
            from f join part on p_partkey = file)
          select file, score, case when score >= 85 then 'critical' when score >= 60 then 'high'
            when score >= 30 then 'moderate' else 'low' end as band from s""",
    ),
    "s01_daily_windows": (
        sessions,
        """select cast(ts as date) as day, event_type, count(*) as n, count(distinct user_id) as users
          from events group by 1, 2""",
    ),
}
