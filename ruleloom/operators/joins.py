"""Range, edit-distance and lookup joins that need no nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.operators.extract import small_table

BUCKET = 1 << 16


def containing_section(strings: DataFrame, sections: DataFrame, width: int = BUCKET) -> DataFrame:
    """Adds `section`: the first section, by start then name, that holds the offset.

    Every row stays, equal ones too: the section is found once for each place of a file
    and joined back. Sections are spread over the buckets of offsets they cover, as far as
    the file has offsets, and joined on file and bucket, so the rows of one large file
    are spread as well.
    """
    places = strings.filter(F.col("file_id").isNotNull() & F.col("offset").isNotNull()).select("file_id", "offset").distinct()
    reach = places.groupBy("file_id").agg(F.min("offset").alias("_least"), F.max("offset").alias("_most"))
    low, high = F.greatest("start", "_least"), F.least(F.col("end") - 1, F.col("_most"))
    covered = (
        sections.join(reach, "file_id")
        .filter((F.col("end") > F.col("start")) & (low <= high))
        .select(
            "file_id",
            F.struct(F.col("start").alias("_lo"), F.col("name").alias("section")).alias("_s"),
            F.col("end").alias("_hi"),
            F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("_bucket"),
        )
    )
    placed = places.withColumn("_bucket", F.floor(F.col("offset") / width))
    inside = placed.join(covered, ["file_id", "_bucket"]).filter((F.col("offset") >= F.col("_s._lo")) & (F.col("offset") < F.col("_hi")))
    first = inside.groupBy("file_id", "offset").agg(F.min("_s").alias("_s")).select("file_id", "offset", F.col("_s.section").alias("section"))
    return strings.join(first, ["file_id", "offset"], "left").select(*strings.columns, "section")


def deletions(name: Column) -> Column:
    """The name and every form with one character left out.

    Two names are one edit apart only if they share such a form.
    """
    n = F.char_length(name)
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)),
    )
    return F.array_distinct(F.concat(F.array(name), cut))


def one_edit_apart(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Pairs of names at edit distance exactly one, by an equi-join on shared forms."""
    a = left.withColumn("_form", F.explode(deletions(F.col(left_name))))
    b = right.withColumn("_form", F.explode(deletions(F.col(right_name))))
    pairs = a.join(b, "_form").filter(F.levenshtein(F.col(left_name), F.col(right_name), 1) == 1)
    return pairs.drop("_form").distinct()


def typosquats(names: DataFrame) -> DataFrame:
    """(…, name, original): a listed misspelling, or one edit from a popular name.

    The popular name earliest in the list wins; well-known names are only matched when
    listed.
    """
    spark = names.sparkSession
    listed = [(typo, original, i) for i, (original, typos) in enumerate(K.POPULAR_TYPOS) for typo in typos]
    popular = [(original, i) for i, (original, _) in enumerate(K.POPULAR_TYPOS)]
    distinct = names.select("name").distinct()
    by_list = distinct.join(small_table(spark, listed, "name string, original string, prio int"), "name")
    near = one_edit_apart(
        distinct.filter(~F.col("name").isin(*K.LEGITIMATE_NAMES)),
        small_table(spark, popular, "original string, prio int"),
        "name",
        "original",
    )
    best = by_list.unionByName(near.select("name", "original", "prio")).groupBy("name").agg(
        F.min_by("original", "prio").alias("original")
    )
    return names.join(best, "name")


def similar_rules(rules: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Rules whose id contains the query, lies in it, or is under `limit` edits away."""
    q = query.lower()
    low = F.lower("rule_id")
    distance = F.levenshtein(F.lit(q), low)
    close = low.contains(q) | F.contains(F.lit(q), low) | (distance < limit)
    return rules.withColumn("distance", distance).filter(close).orderBy("distance", "rule_id")


def rules_in_directory(rules: DataFrame, directory: str) -> DataFrame:
    return rules.filter(F.col("rule_id").startswith(directory + "/")).select("rule_id").distinct().orderBy("rule_id")


def permission_risks(permissions: DataFrame) -> DataFrame:
    """Permissions with their risk; wildcard hosts are judged before the known names."""
    spark = permissions.sparkSession
    rows = [(p, risk) for risk, names in K.PERMISSION_RISKS.items() for p in names]
    p = F.col("permission")
    wide = p.contains("*://*/") | p.isin("http://*/*", "https://*/*")
    pattern_risk = F.when(p == "<all_urls>", "critical").when(wide, "high")
    known = small_table(spark, rows, "permission string, known string")
    return (
        permissions.join(known, "permission", "left")
        .withColumn("risk", F.coalesce(pattern_risk, "known"))
        .drop("known")
        .filter(F.col("risk").isNotNull())
    )
