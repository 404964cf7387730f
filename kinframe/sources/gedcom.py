"""GEDCOM files as tables, by window states over explicitly ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions import text as T
from kinframe.operators.asof import STRETCH, last_seen


def _records(lines: DataFrame, stretch: int | None = STRETCH) -> DataFrame:
    """Lines with level, tag, value, the record they belong to and the tag of level 1 above.

    A file is shared by tasks in stretches of its positions; records may span them.
    """
    line = F.regexp_replace(F.regexp_replace("line", "﻿", ""), r"[\r\n]+$", "")
    parts = F.split(line, " ", 3)
    rows = lines.withColumn("level", F.get(parts, F.lit(0)).try_cast("int")).withColumn("tag", F.get(parts, F.lit(1))).withColumn("val", F.trim(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))))
    rows = rows.where("level IS NOT NULL AND tag IS NOT NULL")
    # a level-0 line of any other kind closes the record: an empty id stands for none
    opens = F.col("tag").startswith("@") & F.col("val").isin("INDI", "FAM")
    told = F.when(opens, F.struct(F.col("tag").alias("id"), F.col("val").alias("kind"))).otherwise(F.struct(F.lit("").alias("id"), F.lit("").alias("kind")))
    # the place of that line, a number, is carried from stretch to stretch: the last of several texts would be found by sorting all lines of a split
    start = F.when(F.col("level") == 0, F.coalesce(F.col("pos").cast("long"), F.lit(-(2**40))))
    rows = last_seen(rows, start, ["src"], "pos", "_start", stretch=stretch).where("_start IS NOT NULL")
    of_start = Window.partitionBy("src", "_start").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rec", F.first(F.when(F.col("level") == 0, told), ignorenulls=True).over(of_start)).drop("_start").where("rec.id <> ''").withColumn("_rid", F.col("rec.id"))
    in_record = Window.partitionBy("src", "_rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("top", F.last(F.when(F.col("level") == 1, F.col("tag")), ignorenulls=True).over(in_record))


def _first(when: Column) -> Column:
    return F.coalesce(F.min_by("val", F.when(when, F.col("pos"))), F.lit(""))


def _listed(when: Column, value: Column | None = None) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", (value if value is not None else F.col("val")).alias("v"))))), lambda x: x.v)


def individuals(lines: DataFrame) -> DataFrame:
    """(src, ged_id, names, givn, surn, marnm, sex, famc, fams, birth and death fields).

    The first GIVN, SURN, _MARNM, place and address part wins, the last DATE wins; an
    empty first place blocks later ones.
    """
    rows = _records(lines).where("rec.kind = 'INDI'")
    lvl, tag, top, val = (F.col(c) for c in ("level", "tag", "top", "val"))
    name = F.trim(F.regexp_replace(F.regexp_replace(val, "/", " "), r"\s+", " "))
    sub = lambda t: (lvl == 2) & (top == "NAME") & (tag == t) & (val != "")
    event = lambda e, level, *tags: (lvl == level) & (top == e) & tag.isin(*tags)
    date = lambda e: F.coalesce(F.max_by("val", F.when(event(e, 2, "DATE"), F.col("pos"))), F.lit(""))
    agg = [
        _listed((lvl == 1) & (tag == "NAME") & (name != ""), name).alias("names"), _first(sub("GIVN")).alias("givn"), _first(sub("SURN")).alias("surn"), _first(sub("_MARNM")).alias("marnm"),
        F.coalesce(F.max_by("val", F.when((lvl == 1) & (tag == "SEX"), F.col("pos"))), F.lit("")).alias("sex"), _listed((lvl == 1) & (tag == "FAMC")).alias("famc"), _listed((lvl == 1) & (tag == "FAMS")).alias("fams"),
    ]
    for e, p in (("BIRT", "birth"), ("DEAT", "death")):
        agg += [date(e).alias(f"{p}_date"), _first(event(e, 2, "PLAC", "ADDR")).alias(f"{p}_place"), _first(event(e, 3, "STAE")).alias(f"{p}_state"), _first(event(e, 3, "CTRY")).alias(f"{p}_country")]
    agg.append(_first(event("BIRT", 3, "CITY")).alias("birth_city"))
    return rows.groupBy("src", "_rid").agg(*agg).withColumnRenamed("_rid", "ged_id")


def families(lines: DataFrame) -> DataFrame:
    """(src, fam_id, husb, wife, chil)."""
    rows = _records(lines).where("rec.kind = 'FAM' AND level = 1")
    last = lambda t: F.max_by("val", F.when(F.col("tag") == t, F.col("pos")))
    return rows.groupBy("src", "_rid").agg(last("HUSB").alias("husb"), last("WIFE").alias("wife"), _listed(F.col("tag") == "CHIL").alias("chil")).withColumnRenamed("_rid", "fam_id")


def people(individuals_: DataFrame) -> DataFrame:
    """(ged_id, variants, name, first, birth, death, country, region) of individuals."""
    variants = T.name_variants(F.col("names"), F.col("givn"), F.col("marnm"), F.col("surn"))
    rows = individuals_.withColumn("variants", variants).withColumn("name", T.best_name(F.col("variants"), F.col("names")))
    return rows.select(
        "ged_id", "variants", "name", T.first_word(F.col("name")).alias("first"), T.first_year(F.col("birth_date")).alias("birth"), T.first_year(F.col("death_date")).alias("death"),
        F.col("birth_country").alias("country"), T.build_region(F.col("birth_state"), F.col("birth_city"), F.col("birth_place")).alias("region"),
    )
