"""Batch commands as functions of tables, composed of the operators. Each returns what a table would hold or what would change."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from partloom.functions import text as T, years as Y
from partloom.operators import dml as K, nested as N, relations as R
from partloom.operators.lineage import cut_lineage
from partloom.operators.publish import Made, Store, run_tables


def backfill(df: DataFrame, column: str, by: Column, table: dict[str, str]) -> DataFrame:
    """Blank values filled by a map."""
    return K.set_where(df, K.blank(F.col(column)) & T.mapped(by, table).isNotNull(), **{column: T.mapped(by, table)})


def merge_map(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(loser, survivor) of each group's rows."""
    first = R.first_of(df, keys, order).select(*keys, F.col("id").alias("survivor"))
    return df.select(*keys, F.col("id").alias("loser")).join(first, keys).where("loser <> survivor").select("loser", "survivor")


def normalize_applications(apps: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, links): years expanded, split and put in order, submodels split, and equal rows merged into the lowest id, with all links following.

    What is split goes, and its clones get the next ids in the order of their originals; a clone may be split again. Every row knows the application that it comes
    from, so that links fan out to all clones and collapse on what those are merged into in one pass, whatever happened between. Links of one application and
    unit become one with the last position that is not blank: the survivor's own counts first, then those of rows that were there, then of clones.
    """
    segments = F.filter(F.transform(F.split("year", r"\|"), T.strip), lambda x: x != "")
    years = F.array_distinct(F.transform(segments, Y.expand_range))
    several = F.col("year").contains("|") & (F.size(years) > 0)
    each = F.when(several, years).otherwise(F.array(Y.expand_range(F.col("year"))))
    rows = apps.select(F.col("id").alias("origin"), "make", "model", "engine", (several & (F.size(years) > 1)).alias("split"), F.posexplode(each).alias("at", "year"))
    rows = cut_lineage(rows.withColumn("id", F.when(~F.col("split"), F.col("origin"))))
    rows = cut_lineage(K.with_ids(rows, apps, [F.col("origin"), F.col("at")]).drop("at"))
    shape = r"^([\w.]+)-([A-Z](?:,[A-Z])+)$"
    letters = F.split(F.regexp_extract("model", shape, 2), ",")
    models = F.when(F.col("model").rlike(shape), F.transform(letters, lambda x: F.concat(F.regexp_extract("model", shape, 1), F.lit("-"), x))).otherwise(F.array("model"))
    parts = rows.select("origin", "make", "engine", "year", F.col("id").alias("was"), (F.col("split") | (F.size(models) > 1)).alias("cloned"), F.size(models).alias("n"), F.posexplode(models).alias("at", "model"))
    parts = cut_lineage(parts.withColumn("id", F.when(F.col("n") == 1, F.col("was"))))
    parts = K.with_ids(parts, rows, [F.col("was"), F.col("at")]).withColumn("year", Y.fix_direction(F.col("year")))
    parts = cut_lineage(parts.select("origin", "id", "cloned", "make", "model", "engine", "year"))
    key = ["make", "model", "engine", "year"]
    merged = parts.groupBy(*key).agg(F.min("id").alias("survivor"), F.count(F.lit(1)).alias("merged"))
    known = cut_lineage(merged)
    to = parts.join(known, key).select(F.col("origin").alias("application_id"), "id", "cloned", "survivor")
    met = links.withColumnRenamed("id", "link").join(to, "application_id")
    order = F.struct((F.col("id") != F.col("survivor")).alias("other"), "cloned", F.when(F.col("cloned"), F.col("id")).alias("clone"), "link")
    last = F.coalesce(F.max_by("position", F.when(F.col("position") != "", order)), F.lit(""))
    out = met.groupBy(F.col("survivor").alias("application_id"), "unit_id").agg(last.alias("position"), F.count(F.lit(1)).alias("merged"))
    return known.withColumnRenamed("survivor", "id"), out


def cleanup_applications(apps: DataFrame, links: DataFrame, renames: dict[str, str], pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(applications, links): text tidied, makes renamed, hyphens repaired; then a variant make's rows that the base make has too, and
    equal rows, merged into the lowest id. Links follow; those of one application and unit become one with the last position that is not blank.
    """
    tidy = lambda c: T.repair_hyphen(T.tidy_model(F.col(c)))
    rows = apps.withColumns({c: tidy(c) for c in ("make", "model", "engine")}).withColumn("make", T.renamed(F.col("make"), renames))
    rows = cut_lineage(rows)
    key = ["model", "engine", "year"]
    for base, variant in pairs:
        known = rows.where(F.col("make") == base).groupBy(*key).agg(F.min("id").alias("survivor"))
        to_base = cut_lineage(rows.where(F.col("make") == variant).join(known, key).select(F.col("id").alias("loser"), "survivor"))
        rows = rows.join(to_base.select(F.col("loser").alias("id")), "id", "left_anti")
        links = K.repoint(links, to_base, "application_id", ["unit_id"], ["position"])
    rows = cut_lineage(rows)
    equal = cut_lineage(merge_map(rows, ["make", *key], [F.col("id")]))
    return rows.join(equal.select(F.col("loser").alias("id")), "id", "left_anti"), K.repoint(links, equal, "application_id", ["unit_id"], ["position"])


def acronyms(df: DataFrame, column: str, explicit: list[str], longest: int = 4) -> DataFrame:
    """(word, form) of names in capitals that stay so: the explicit ones, and single words of at most `longest` letters or digits that the column has in capitals."""
    word = T.strip(F.regexp_replace(T.strip(F.col(column)), r"\.+$", ""))
    short = df.select(word.alias("word")).where(F.col("word").rlike(f"^[A-Z0-9]{{1,{longest}}}$") & F.col("word").rlike("[A-Z]")).distinct()
    given = df.sparkSession.createDataFrame([(x.upper(), x) for x in explicit], "word string, form string")
    return short.join(given, "word", "left_anti").withColumn("form", F.col("word")).unionByName(given)


#: Up to so many distinct names are sent to all tasks; of more, those of over OFTEN rows are.
NAMES, OFTEN = 100_000, 200_000


def with_maker_names(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """df with makers' names in one spelling: tokens that words (word, form) has in its form, others in title case, as maker_name() does with a map.

    Each distinct name is taken apart once and its tokens are joined with the words, of which there may be any number. Rows do not move to the few
    names that most of them have.
    """
    names = cut_lineage(df.groupBy(F.col(column).alias("_name")).agg(F.count(F.lit(1)).alias("_n")))
    bare = T.strip(F.regexp_replace(T.strip(F.coalesce("_name", F.lit(""))), r"\.+$", ""))
    tokens = names.select("_name", F.posexplode(F.filter(F.split(bare, T.BLANK), lambda t: t != "")).alias("_at", "_token")).withColumn("word", F.upper("_token"))
    formed = tokens.join(words, "word", "left").select(F.col("_name").alias("_of"), F.struct("_at", F.coalesce("form", T.title_case(F.col("_token"))).alias("form")).alias("t"))
    built = formed.groupBy("_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["form"]), " ").alias("_built"))
    spelled = names.join(built, F.col("_name").eqNullSafe(F.col("_of")), "left").select("_name", "_n", F.coalesce("_built", F.lit("")).alias("_built"))
    known = F.col(column).eqNullSafe(F.col("_name"))
    laid = lambda rows, table: rows.join(table, known).withColumn(column, F.col("_built")).select(*df.columns)
    if names.count() <= NAMES:
        return laid(df, F.broadcast(spelled))
    often, seldom = F.broadcast(spelled.where(F.col("_n") > OFTEN)), spelled.where(F.col("_n") <= OFTEN)
    return laid(df, often).unionByName(laid(df.join(often, known, "left_anti"), seldom))


def normalize_makers(xrefs: DataFrame, explicit: list[str]) -> DataFrame:
    """xrefs with makers in one spelling; of those alike then in unit, number and maker the one with the longest notes stays, of equals the lowest id."""
    named = with_maker_names(xrefs, "interchange_type", acronyms(xrefs, "interchange_type", explicit))
    return R.first_of(named, ["unit_id", "cross_ref_number", "interchange_type"], [F.length(F.coalesce("notes", F.lit(""))).desc(), F.col("id")])


def cleanup_xrefs(xrefs: DataFrame, renames: dict[str, str], pairs: list[tuple[str, str]]) -> DataFrame:
    """What is left of cross references, step by step: open parentheses and page references cut off, mere page references deleted, numbers that
    their unit and maker have with an annotation deleted, makers renamed, and a variant maker's numbers that the base maker has deleted.

    Of rows that a cut or a new name makes alike in unit, maker and number, one that had it already stays, else the lowest id.
    Cuts leave what a number has before its first space or parenthesis, its stem: rows move once, by unit and stem, and all steps go on where they lie.
    """
    number, maker, unit, whole = F.col("cross_ref_number"), "interchange_type", ["unit_id", "_stem"], F.col("unit_id").isNotNull() & F.col("cross_ref_number").isNotNull()
    out = xrefs.withColumn("_stem", F.regexp_extract(T.strip(number), r"^[^\s(]*", 0)).repartition(*unit)
    for fix in (T.drop_open_paren, T.drop_page_reference):
        out = R.rewritten(out, "cross_ref_number", T.nullif_blank(T.strip(fix(number))), [*unit, maker], [F.col("id")])
    named = ~F.coalesce(T.is_page_reference(number), F.lit(False))
    tagged = out.withColumns({"_brand": F.lower(F.coalesce(maker, F.lit(""))), "_base": T.strip(T.annotation(number)["base"])})
    # each row stands under its number, and once more under its number without the annotation, if it has one; as a generator's rows, since a filter by number would be worked out before the cuts too
    under = [F.when(cond, F.struct(c.alias("under"), F.lit(tags).alias("tags"))) for cond, c, tags in ((named, number, False), (named & F.col("_base").isNotNull(), F.col("_base"), True))]
    twice = tagged.withColumn("_u", F.explode(F.array(*under))).where("_u IS NOT NULL").withColumns({"_under": F.col("_u.under"), "_tags": F.col("_u.tags")})
    of = Window.partitionBy(*unit, "_brand", "_under")
    others = lambda f: F.when(whole, f(F.when(F.col("_tags"), F.col("id"))).over(of))
    found = twice.withColumns({"_by": others(F.min), "_or": others(F.max)}).where("NOT _tags")
    out = found.where(F.col("_by").isNull() | ((F.col("_by") == F.col("id")) & (F.col("_or") == F.col("id")))).select(*xrefs.columns, "_stem")
    out = R.rewritten(out, maker, T.mapped(F.col(maker), renames), [*unit, "cross_ref_number"], [F.col("id")])
    for base, variant in pairs:
        had = whole & F.coalesce(F.max(F.col(maker) == base).over(Window.partitionBy(*unit, "cross_ref_number")), F.lit(False))
        out = out.withColumn("_had", had).where(~(F.col("_had") & F.coalesce(F.col(maker) == variant, F.lit(False)))).drop("_had")
    return out.select(*xrefs.columns)


def unit_category(generator_makers: Iterable[str]) -> Column:
    """A unit's category by family, yt number, maker and type, '' if nothing tells."""
    family, yt = F.upper(F.trim("family")), F.trim("yt_number")
    return (
        F.when(family == "TILT&TRIM", "Motor").when(family.isin("DD", "PMGR"), "Starter").when(yt.rlike(r"^[45]\d{5}$"), "Generator")
        .when(yt.rlike(r"^\d{6,}$") & F.col("manufacturer").isin(*generator_makers), "Generator").when(F.col("unit_type") != "", F.col("unit_type"))
        .when(F.col("manufacturer") == "Romaine Electric", "Alternator").otherwise("")
    )


def cleanup_units(units: DataFrame, xrefs: DataFrame, links: DataFrame, generator_makers: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(units, links): numbers without commas at their end, merged into the unit that has it; blank categories and yt numbers told; test units deleted.

    A yt number is that of the number itself for numeric motors, else of the first unit with a cross reference to it. Bare units, with nothing but a number, stay as they are.
    """
    bare = (F.col("yt_number") == "") & (F.col("manufacturer") == "") & (F.col("category") == "")
    cut = F.regexp_replace(T.strip(F.col("unit_number")), ",+$", "")
    dirty = units.where(~bare & F.col("unit_number").endswith(",")).withColumn("_clean", cut)
    keeper = units.groupBy(F.col("unit_number").alias("_clean")).agg(F.min("id").alias("survivor"))
    mapping = cut_lineage(dirty.join(keeper, "_clean").select(F.col("id").alias("loser"), "survivor"))
    links = R.moved(links, mapping, "unit_id", ["application_id"], [F.col("id")])
    left = units.join(mapping.select(F.col("loser").alias("id")), "id", "left_anti")
    left = left.withColumn("unit_number", F.when(~bare & F.col("unit_number").endswith(","), cut).otherwise(F.col("unit_number")))
    left = cut_lineage(left.withColumn("category", F.when(~bare & (F.col("category") == ""), unit_category(generator_makers)).otherwise(F.col("category"))))
    hosts = xrefs.join(left.where("yt_number <> ''").select(F.col("id").alias("unit_id"), F.col("yt_number").alias("_yt")), "unit_id")
    host = hosts.groupBy(F.col("cross_ref_number").alias("unit_number")).agg(F.min_by("_yt", "unit_id").alias("_yt"))
    motor = (F.col("category") == "Motor") & F.col("unit_number").rlike(r"^45\d{4}$")
    told = F.when(motor, F.col("unit_number")).otherwise(F.coalesce("_yt", F.lit("")))
    wants = ~bare & (F.col("yt_number") == "") & (F.coalesce("unit_number", F.lit("")) != "")
    out = left.join(host, "unit_number", "left").withColumn("yt_number", F.when(wants, told).otherwise(F.col("yt_number"))).select(*units.columns)
    test = (F.lower(F.coalesce("unit_number", F.lit(""))) == "test") | (F.lower("yt_number") == "test")
    out = cut_lineage(out)
    return out.where(~test), K.cascade(links, out.where(test), "unit_id")


def import_applications(filled: DataFrame, units: DataFrame) -> DataFrame:
    """Staged rows, blanks filled down, as one application for each make, model, engine, number, maker and transmission.

    Years, options and other numbers are joined in the order in which they come first. Rows without a number, and those whose number is a
    cross reference, are left out. unit_id is the unit of that number, null if one is to be created.
    """
    bare = F.regexp_replace("part_number", ",+$", "")
    seen = filled.groupBy("make", "model", "engine", "part_number", "mfr", "year", "options").agg(F.min("pos").alias("pos"))
    rows = seen.where((F.col("part_number") != "") & ~bare.startswith("400-") & ~bare.startswith("410-"))
    rows = rows.withColumn("_x", T.take_token(F.col("options"), ("Automatic", "Manual"))).withColumns({"transmission": F.col("_x.token"), "options": F.col("_x.rest")})
    key = ["make", "model", "engine", "part_number", "mfr", "transmission"]
    told = lambda c: F.array_join(F.filter(F.array_distinct(F.transform("_rows", lambda r: r[c])), lambda v: v != ""), " | ")
    out = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "year", "options"))).alias("_rows")).select(*key, told("year").alias("year"), told("options").alias("options"))
    number = units.where("unit_number IS NOT NULL").groupBy(F.col("unit_number").alias("part_number")).agg(F.max("id").alias("unit_id"))
    return out.join(number, "part_number", "left").select(
        F.coalesce(T.nullif_blank(T.join_non_blank(" ", *[F.col(c) for c in ("make", "model", "engine", "transmission")])), F.lit("Unknown")).alias("name"),
        *key, Y.expand_import(F.coalesce("year", F.lit(""))).alias("year"),
        T.join_non_blank(" | ", F.col("transmission"), F.coalesce("options", F.lit(""))).alias("options"), "unit_id",
    )


def import_interchange(routed: DataFrame, units: DataFrame, xrefs: DataFrame, interchanges: DataFrame) -> DataFrame:
    """(output, target_id, maker, their_number, pos, other_id): routed rows without bogus makers, one a number, maker and target, that are not stored yet.

    Numbers are cut to 100 characters and makers to 150. xrefs are stored by (unit_id, cross_ref_number, interchange_type), interchanges by (part_id,
    interchange_number, source_name). A unit's row has in other_id the unit that the number is, if it is another.
    """
    maker, number = F.substring(T.normalize_space(F.col("manufacturer")), 1, 150), F.substring("their_number", 1, 100)
    rows = routed.where((maker != "") & (F.col("route") != "none")).withColumns({"maker": maker, "whole": F.col("their_number"), "their_number": number})
    output = F.when(F.col("route") == "part_yt", "part").otherwise("unit")
    key = ["output", "target_id", "maker", "their_number"]
    new = rows.withColumn("output", output).groupBy(*key).agg(F.min_by("whole", "pos").alias("whole"), F.min("pos").alias("pos"))
    stored = lambda df, output, *columns: df.select(F.lit(output).alias("output"), *[F.col(c).alias(k) for c, k in zip(columns, key[1:], strict=True)])
    have = stored(xrefs, "unit", "unit_id", "interchange_type", "cross_ref_number").unionByName(stored(interchanges, "part", "part_id", "source_name", "interchange_number"))
    named = units.where("unit_number <> ''").groupBy(F.col("unit_number").alias("whole")).agg(F.max("id").alias("_other"))
    left = new.join(have.distinct(), key, "left_anti").join(named, "whole", "left")
    other = F.when((F.col("output") == "unit") & (F.col("_other") != F.col("target_id")), F.col("_other"))
    return left.select(*key, "pos", other.alias("other_id"))


#: A BOM of up to so many different parts is compared with its unit's parts as a list.
LISTED = 1000


def missing_bom_items(boms: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """(bom_id, part_id) of BOMs (bom_id, unit_id) and the parts of their units, links (unit_id, part_id), that no item has.

    A BOM takes its items to its unit as a list, so that what the links make of it does not move. BOMs of several units, and those
    with more than LISTED parts, are rare: their rows are made different and compared with items by a join.
    """
    links = links.select("unit_id", "part_id").distinct()
    had = items.where("bom_id IS NOT NULL AND part_id IS NOT NULL").groupBy("bom_id").agg(F.collect_set("part_id").alias("_had"))
    of = boms.where("bom_id IS NOT NULL").groupBy("bom_id").agg(F.min("unit_id").alias("unit_id"), F.max("unit_id").alias("_last"))
    of = of.join(had, "bom_id", "left").withColumn("_listed", (F.col("unit_id") == F.col("_last")) & (F.coalesce(F.size("_had"), F.lit(0)) <= LISTED))
    has = F.coalesce(F.array_contains("_had", F.col("part_id")), F.lit(False))
    listed = of.where("_listed").join(links, "unit_id").where(~has).select("bom_id", "part_id")
    others = boms.join(of.where("NOT _listed").select("bom_id"), "bom_id", "left_semi").unionByName(boms.where("bom_id IS NULL"))
    rest = others.join(links, "unit_id").select("bom_id", "part_id").distinct().join(items.select("bom_id", "part_id"), ["bom_id", "part_id"], "left_anti")
    return listed.unionByName(rest)


def clean_bom_items(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Items moved to the surviving parts, those alike in BOM, part and quantity once."""
    return K.repoint(items, mapping, "part_id", ["bom_id", "unit_qty"], ["description"])


def bare_units(units: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, kind, target) of units with nothing but a number: it is the yt number of a real unit (`unit`), else of a part (`part`), else of `none`."""
    bare = (F.col("yt_number") == "") & (F.col("manufacturer") == "") & (F.col("unit_type_category") == "")
    of = lambda df, name: df.where("yt_number <> ''").groupBy(F.col("yt_number").alias("unit_number")).agg(F.max("id").alias(name))
    found = units.where(bare).select("id", "unit_number").join(of(units.where(~bare), "_unit"), "unit_number", "left").join(of(parts, "_part"), "unit_number", "left")
    kind = F.when(F.col("_unit").isNotNull(), "unit").when(F.col("_part").isNotNull(), "part").otherwise("none")
    return found.select("id", kind.alias("kind"), F.coalesce("_unit", "_part").alias("target"))


@dataclass
class Migrated:
    """Tables after units were folded into others."""

    units: DataFrame
    xrefs: DataFrame
    links: DataFrame
    interchanges: DataFrame


def redirect(rows: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """rows in which `key` points to the survivor (loser, survivor); a null survivor clears it."""
    to = mapping.select(F.col("loser").alias(key), F.col("survivor").alias("_to"), F.lit(True).alias("_hit"))
    return rows.join(to, key, "left").withColumn(key, F.when(F.col("_hit"), F.col("_to")).otherwise(F.col(key))).drop("_to", "_hit")


def fold_bare_units(units: DataFrame, parts: DataFrame, xrefs: DataFrame, links: DataFrame, interchanges: DataFrame) -> Migrated:
    """Bare units of a real unit give it their cross references, those of a part become its interchanges; both go. The others stay.

    A cross reference that the real unit has already is dropped, as is an interchange that the part has; references to a unit that goes
    follow it, or are cleared. interchanges are (part_id, interchange_number, source_name, notes, new).
    """
    kinds = cut_lineage(bare_units(units, parts))
    to_unit = kinds.where("kind = 'unit'").select(F.col("id").alias("loser"), F.col("target").alias("survivor"))
    to_part = kinds.where("kind = 'part'").select(F.col("id").alias("unit_id"), F.col("target").alias("part_id"))
    gone = kinds.where("kind <> 'none'").select("id")
    after = R.moved(xrefs, to_unit, "unit_id", ["cross_ref_number", "interchange_type"], [F.col("id")])
    after = after.join(to_part.select("unit_id"), "unit_id", "left_anti")
    after = redirect(after, "cross_ref_unit_id", to_unit.unionByName(to_part.select(F.col("unit_id").alias("loser"), F.lit(None).cast("long").alias("survivor"))))
    key = ["part_id", "interchange_number", "source_name"]
    made = xrefs.join(to_part, "unit_id").select("part_id", F.substring("cross_ref_number", 1, 100).alias("interchange_number"), F.substring("interchange_type", 1, 150).alias("source_name"), "id", "notes")
    first = R.first_of(made.join(interchanges.select(*key), key, "left_anti"), key, [F.col("id")])
    both = interchanges.select(*key, "notes", F.lit(False).alias("new")).unionByName(first.select(*key, "notes", F.lit(True).alias("new")))
    return Migrated(units.join(gone, "id", "left_anti"), after, K.cascade(links, gone, "unit_id"), both)


def fold_alias_units(units: DataFrame, xrefs: DataFrame, links: DataFrame) -> Migrated:
    """Units that are only another number of a real unit with their yt number go; their application links and references to them follow it."""
    text = ("manufacturer", "oem", "voltage", "amp_rating")
    blank = F.col("unit_type_id").isNull()
    for c in text:
        blank = blank & (F.col(c) == "")
    known = xrefs.where("cross_ref_number <> ''").select(F.col("cross_ref_number").alias("unit_number")).distinct()
    shells = units.where(blank & (F.col("yt_number") != "")).join(known, "unit_number", "left_semi")
    real = units.where(~blank).groupBy("yt_number").agg(F.min("id").alias("survivor"))
    mapping = cut_lineage(shells.select(F.col("id").alias("loser"), "unit_number", "yt_number").join(real, "yt_number"))
    ranked = links.join(mapping.select(F.col("loser").alias("unit_id"), "yt_number", "unit_number"), "unit_id", "left")
    after = R.moved(ranked, mapping, "unit_id", ["application_id"], [F.col("yt_number"), F.col("unit_number"), F.col("id")]).select(*links.columns)
    gone = mapping.select(F.col("loser").alias("id"))
    left = redirect(K.cascade(xrefs, gone, "unit_id"), "cross_ref_unit_id", mapping)
    return Migrated(units.join(gone, "id", "left_anti"), left, after, None)


def merge_unit_boms(boms: DataFrame, items: DataFrame, unique: Callable[[DataFrame], DataFrame], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(boms, items) after the BOMs of each unit were merged into the first in `order`, over id, unit_id and their number of items n.

    unique adds the column `_unique` to items; an item that moves is dropped if the BOM that stays has it. The BOMs are merged in order, items by id.
    """
    sizes = items.groupBy(F.col("bom_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    sized = boms.where("unit_id IS NOT NULL").select("id", "unit_id").join(sizes, "id", "left").fillna(0, ["n"])
    nth = Window.partitionBy("unit_id").orderBy(*order)
    placed = sized.withColumn("_nth", F.row_number().over(nth)).withColumn("survivor", F.first("id").over(nth))
    mapping = cut_lineage(placed.where("id <> survivor").select(F.col("id").alias("loser"), "survivor", "_nth"))
    after = R.moved(unique(items), mapping, "bom_id", ["_unique"], [F.col("_nth"), F.col("id")], ["_nth"])
    return boms.join(mapping.select(F.col("loser").alias("id")), "id", "left_anti"), after.select(*items.columns)


def cleanup_boms(boms: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boms, items): items without number and text deleted, a unit's BOMs merged into the one with most items, those left without items deleted."""
    real = items.where((F.col("yt_number") != "") | (F.col("description") != "") | (F.col("j_and_n") != ""))
    yt = F.lower(F.trim(F.coalesce("yt_number", F.lit(""))))
    key = F.when(yt != "", F.concat(F.lit("yt "), yt)).otherwise(F.concat(F.lit("text "), F.lower(F.trim(F.coalesce("description", F.lit(""))))))
    left, after = merge_unit_boms(boms, real, lambda df: df.withColumn("_unique", key), [F.col("n").desc(), F.col("id")])
    after = cut_lineage(after)
    return left.join(after.select(F.col("bom_id").alias("id")), "id", "left_semi"), after


def empty_boms(boms: DataFrame, items: DataFrame, parts: DataFrame) -> DataFrame:
    """(id) of a unit's BOMs without an item of a numbered part, where the unit has another BOM with one."""
    numbered = parts.where("part_number IS NOT NULL AND part_number <> ''").select(F.col("id").alias("part_id"))
    real = items.join(numbered, "part_id", "left_semi").select(F.col("bom_id").alias("id")).distinct()
    owned = boms.where("unit_id IS NOT NULL").select("id", "unit_id")
    return owned.join(real, "id", "left_anti").join(owned.join(real, "id", "left_semi").select("unit_id"), "unit_id", "left_semi").select("id")


def export_seed(tables: dict[str, DataFrame], private: Iterable[str]) -> dict[str, DataFrame]:
    """The tables as a seed: private ones without rows, and a row without a seed_id has its id."""
    out = {}
    for name, df in tables.items():
        df = df.where(F.lit(False)) if name in private else df
        out[name] = df.withColumn("seed_id", F.coalesce("seed_id", "id")) if "seed_id" in df.columns else df
    return out


@dataclass
class Synced:
    """A table with the seed's rows added and blanks filled, `change` (insert, fill or kept), and the counts of the run."""

    rows: DataFrame
    counts: DataFrame


@dataclass(frozen=True)
class SyncTable:
    target: DataFrame
    seed: DataFrame
    unique: tuple[str, ...]
    fill: tuple[str, ...]
    protected: tuple[str, ...] = ()


def sync_table(t: SyncTable) -> Synced:
    """seed_ids are filled where the seed knows the id, new seed rows are added, and blanks filled, but for columns of the customer's own.

    counts are (inserted, conflicts, updated, skipped): rows added, rows not added for a value that is taken, values filled, and what is left of the seed.
    """
    target = cut_lineage(K.backfilled(t.target, t.seed))
    new = cut_lineage(K.insert_only(target, t.seed, list(t.unique)))
    filled = K.fill_blanks(target, t.seed, list(t.fill), list(t.protected))
    old = target.select("id", *[F.col(c).alias(f"_old_{c}") for c in t.fill])
    n_filled = sum((F.when(F.col(c).eqNullSafe(F.col(f"_old_{c}")), 0).otherwise(1) for c in t.fill), F.lit(0))
    kept = filled.join(old, "id").withColumn("_filled", n_filled).withColumn("change", F.when(F.col("_filled") > 0, "fill").otherwise("kept"))
    columns = [c for c in target.columns if c != "id"]
    added = K.with_ids(new.withColumn("id", F.lit(None).cast("long")), target, [F.col("seed_id")]).select("id", *columns, F.lit(0).alias("_filled"), F.lit("insert").alias("change"))
    rows = cut_lineage(kept.select("id", *columns, "_filled", "change").unionByName(added))
    seeded = t.seed.where("seed_id IS NOT NULL")
    unknown = seeded.join(target.select("seed_id"), "seed_id", "left_anti").agg(F.count(F.lit(1)).alias("_unknown"))
    total = seeded.agg(F.count(F.lit(1)).alias("_total"))
    of_rows = rows.agg(F.count_if(F.col("change") == "insert").alias("inserted"), F.coalesce(F.sum("_filled"), F.lit(0)).alias("updated"))
    one = of_rows.withColumn("_k", F.lit(1)).join(unknown.withColumn("_k", F.lit(1)), "_k").join(total.withColumn("_k", F.lit(1)), "_k")
    counts = one.select("inserted", (F.col("_unknown") - F.col("inserted")).alias("conflicts"), "updated", F.greatest(F.lit(0), F.col("_total") - F.col("_unknown") - F.col("updated")).alias("skipped"))
    return Synced(rows.drop("_filled"), counts)


COUNTS = ("inserted", "conflicts", "updated", "skipped")


def sync_catalog(store: Store, run: str, tables: dict[str, SyncTable], budget: float, clock: Callable[[], float] = time.monotonic) -> list[Row]:
    """Synchronises tables in order until the budget of seconds is spent, and gives a report row of each.

    The time is looked at before each table. A table that is whole is in the run's progress, so that an attempt that is killed or out of time is gone on with
    by the next one of the same run; readers of the store see all of the run's tables at once, when the last is whole.
    """
    end = clock() + budget

    def made(t: SyncTable) -> Made:
        synced = sync_table(t)
        return synced.rows, synced.counts.first().asDict()

    told = run_tables(store, run, {name: (lambda t=t: made(t)) for name, t in tables.items()}, lambda: clock() < end)
    return [Row(table_name=name, state=state, **{c: int(counts.get(c, 0)) if state == "done" else 0 for c in COUNTS}) for name, (state, counts) in told.items()]


def _completed(rows: DataFrame, all_rows: DataFrame, scope: list[str], number: str, name: str) -> DataFrame:
    """rows with a flag `name`: whether a number of the scope that does not end with a dash starts with the row's, less its last character. Case is folded."""
    key = lambda value: R.scoped(scope, F.lower(value)).alias("value")
    stem = F.substring(F.col(number), F.lit(1), F.length(number) - 1)
    asked = rows.withColumn("_stem", key(stem))
    found = R.prefixes_of(asked.select(F.col("_stem").alias("value")), all_rows.where(~F.col(number).endswith("-")).select(key(F.col(number))), proper=False)
    told = found.select(F.col("value").alias("_stem"), F.lit(True).alias(name))
    return asked.join(told, "_stem", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_stem")


def cleanup_fragments(df: DataFrame, owner: str, number: str, label: str, siblings: bool = True) -> DataFrame:
    """(id, action, number, label) of each number that ends with a dash, other than a lone dash; with the values that it had or, if merged, gets.

    First pass: a label that begins with a suffix completes the number: `delete` if the owner has the
    whole number already or a lower id gets the same number and label, else `merge`. Without a suffix,
    `delete` if a number of the owner completes it. Orphan pass, over what the first one left: `orphan`
    if a number of the owner or of any other completes it, if it looks broken, or (with `siblings`) if the
    owner has another fragment of the same label. What stays a fragment is `manual`, or `merge` if it was merged.
    """
    x = df.select("id", owner, F.col(number).alias("number"), F.col(label).alias("label"))
    dash = F.col("number").endswith("-") & (F.col("number") != "-")
    rows = x.where(dash).withColumn("_s", T.label_suffix(F.col("label")))
    with_suffix = rows.where("_s.suffix <> ''").select(
        "id", owner, "number", "label", F.concat("number", "_s.suffix").alias("_number"), F.coalesce(T.nullif_blank(F.col("_s.maker")), "label").alias("_label")
    )
    have = x.select(owner, F.col("number").alias("_number")).distinct().withColumn("_have", F.lit(True))
    checked = with_suffix.join(have, [owner, "_number"], "left")
    first = R.survivors(checked.where("_have is null"), [owner, "_number", "_label"], [F.col("id")])
    bare = cut_lineage(_completed(rows.where("_s.suffix = ''").drop("_s"), x, [owner], "number", "_done"))
    same = ["id", owner, "number", "label"]
    gone = checked.where("_have").select(*same).unionByName(first.where("not survivor").select(*same)).unionByName(bare.where("_done").select(*same))
    merged = first.where("survivor").select("id", owner, F.col("_number").alias("number"), F.col("_label").alias("label"), F.lit("merge").alias("action"))
    left = cut_lineage(merged.unionByName(bare.where("not _done").select(*same, F.lit("manual").alias("action"))))
    now = x.where(~F.coalesce(dash, F.lit(False))).unionByName(left.select(*same))
    open_ = _completed(_completed(left.where(dash), now, [owner], "number", "_own"), now, [], "number", "_any")
    broken = F.size(T.artifact_reasons(F.col("number"), F.col("label"))) > 0
    if siblings:
        twins = left.where(dash).groupBy(owner, F.struct("label").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
        open_ = open_.withColumn("_of", F.struct("label")).join(twins, [owner, "_of"], "left")
        broken = broken | (F.col("_n") > 1)
    judged = open_.withColumn("action", F.when(F.col("_own") | F.col("_any") | broken, "orphan").otherwise(F.col("action")))
    out = gone.withColumn("action", F.lit("delete")).unionByName(left.where(~dash)).unionByName(judged.select(*same, "action"))
    return out.select("id", "action", F.col("number").alias(number), F.col("label").alias(label))


def classify_parts(parts: DataFrame, name: str, rules: list[tuple[str, list[str]]], overwrite: bool = False) -> DataFrame:
    """parts with the category of the first rule that their name fits; only blank ones are changed, unless overwrite. Names that no rule fits change nothing."""
    found = T.first_match(F.col(name), rules)
    open_ = F.lit(True) if overwrite else F.coalesce("category", F.lit("")) == ""
    return parts.withColumn("category", F.when(open_ & found.isNotNull(), found).otherwise(F.col("category")))


#: Text columns of parts that a clean-up tidies, and those that may end with a page reference or an open parenthesis.
_PART_TEXT = ("part_number", "part_name", "manufacturer_number", "yt_number", "j_and_n", "oem", "category", "voltage")
_PART_NUMBERS = ("part_number", "part_name", "manufacturer_number")


def tidy_parts(parts: DataFrame, whitelist: dict[str, str], renames: dict[str, str]) -> DataFrame:
    """parts with single spaces, without open parentheses and page references where something is left, and with makers' names in one spelling."""
    out = parts.withColumns({c: F.regexp_replace(T.strip(F.col(c)), " {2,}", " ") for c in _PART_TEXT})
    for fix in (T.drop_open_paren, T.drop_page_reference):
        out = out.withColumns({c: F.coalesce(T.nullif_blank(T.strip(fix(F.col(c)))), F.col(c)) for c in _PART_NUMBERS})
    maker = T.renamed(T.maker_name(F.col("oem"), whitelist), renames)
    return out.withColumn("oem", F.coalesce(T.nullif_blank(maker), F.col("oem")))


def cleanup_parts(
    parts: DataFrame, boms: DataFrame, items: DataFrame, whitelist: dict[str, str], renames: dict[str, str], variants: list[tuple[str, str]]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, boms, items) after text was tidied, parts of one number merged, equal items collapsed and empty BOMs deleted.

    Parts of one yt number whose makers, blanks aside, are one go to the most complete. Then those of a variant's maker go to the lowest
    part of the base maker with their number. Items follow; one that its BOM has already, by part and quantity, goes.
    """
    tidy = cut_lineage(tidy_parts(parts, whitelist, renames))
    numbered = tidy.where("yt_number <> ''")
    one = numbered.groupBy("yt_number").agg(F.count_distinct(T.nullif_blank(F.col("oem"))).alias("_makers")).where("_makers = 1").drop("_makers")
    score = R.completeness(list(_PART_TEXT), ["cost_price", "price"])
    mapping = cut_lineage(merge_map(numbered.join(one, "yt_number").withColumn("_score", score), ["yt_number"], [F.col("_score").desc(), F.col("id")]))
    moves = [mapping]
    left = cut_lineage(tidy.join(mapping.select(F.col("loser").alias("id")), "id", "left_anti"))
    for base, variant in variants:
        known = left.where((F.col("yt_number") != "") & (F.col("oem") == base)).groupBy("yt_number").agg(F.min("id").alias("survivor"))
        more = cut_lineage(left.where(F.col("oem") == variant).join(known, "yt_number").select(F.col("id").alias("loser"), "survivor").where("loser <> survivor"))
        moves.append(more)
        left = left.join(more.select(F.col("loser").alias("id")), "id", "left_anti")
    ends = _united([m.select(F.explode(F.array("loser", "survivor")).alias("part_id")) for m in moves]).distinct().withColumn("_moving", F.lit(True))
    told = cut_lineage(R.looked_up(items, ends, "part_id"))
    at_ends = told.where("_moving").drop("_moving")  # only items of parts that are moved or moved to can meet
    for mapping in moves:
        at_ends = R.moved(at_ends, mapping, "part_id", ["bom_id", "unit_qty"], [F.col("id")])
    items = told.where("_moving IS NULL").drop("_moving").unionByName(at_ends)
    items = cut_lineage(R.first_of(items, ["bom_id", "part_id", "unit_qty"], [F.col("id")]))
    return left, boms.join(items.select(F.col("bom_id").alias("id")), "id", "left_semi"), items


def staged_entities(staged: DataFrame, known: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """(key, id, fill..., change) of all staged keys: what is stored, blanks filled by the first staged value that is not blank, by pos. id is null for new ones."""
    first = staged.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(*[F.min_by(F.col(c), F.when(~K.blank(F.col(c)), F.col("pos"))).alias(f"_{c}") for c in fill])
    stored = known.groupBy(key).agg(F.max("id").alias("id"), *[F.max_by(F.coalesce(c, F.lit("")), "id").alias(c) for c in fill])
    both = first.join(stored, key, "left")
    filled = {c: F.coalesce(T.nullif_blank(F.col(c)), F.col(f"_{c}"), F.lit("")) for c in fill}
    differs = F.lit(False)
    for c in fill:
        differs = differs | (filled[c] != F.coalesce(c, F.lit("")))
    change = F.when(F.col("id").isNull(), "created").when(differs, "updated").otherwise("kept")
    return both.select(key, "id", *[v.alias(c) for c, v in filled.items()], change.alias("change"))


def new_relations(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """The first row by pos of each key that known lacks."""
    return R.first_of(rows.join(known.select(*key), key, "left_anti"), key, [F.col("pos")])


def import_master(staged: DataFrame, refs: DataFrame, known: DataFrame, prefix: str = "JN:") -> dict[str, DataFrame]:
    """parts, and relations by kind (number, part_id, other, other_id, ref_number, notes): a catalog's parts and what its references say, by their own numbers.

    New parts get ids in the order of the file, and relations point to parts by id, new ones included.
    A part superseded by one of the catalog makes that one's superseding; by another it only gets a line of notes. The first of several
    equal relations counts. `other` is the part that a number is, where the catalog has it and it is not the part itself.
    """
    clean = staged.withColumns({c: T.normalize_space(F.col(c)) for c in ("number", "part_name", "category", "code")})
    named = clean.withColumns({"part_name": F.coalesce(T.nullif_blank(F.col("part_name")), F.lit("")), "category": F.coalesce(T.nullif_blank(F.col("category")), F.col("code"))})
    parts = cut_lineage(staged_entities(named, known, "number", ["part_name", "category"]))
    first_name = R.first_of(named.where("number <> ''"), ["number"], [F.col("pos")]).select("number", F.coalesce(T.nullif_blank(F.col("part_name")), F.col("number")).alias("_first"))
    first_at = named.where("number <> ''").groupBy("number").agg(F.min("pos").alias("_pos"))
    parts = parts.join(first_name, "number").withColumn("part_name", F.when(F.col("change") == "created", F.col("_first")).otherwise(F.col("part_name"))).drop("_first")
    parts = cut_lineage(K.with_ids(cut_lineage(parts.join(first_at, "number")), known, [F.col("_pos")]).drop("_pos"))
    have = parts.select("number")
    rows = refs.select("pos", *[T.normalize_space(F.col(c)).alias(c) for c in ("number", "ref_number", "ref_type", "maker", "notes")]).where("ref_number <> ''").join(have, "number", "left_semi")
    rows = rows.join(have.select(F.col("number").alias("ref_number"), F.col("number").alias("other")), "ref_number", "left").withColumn("other", F.nullif("other", "number"))
    kind = F.lower(F.coalesce(T.nullif_blank(F.col("ref_type")), F.lit("reference")))
    rows = rows.withColumns({"kind": kind, "text": T.join_non_blank(" | ", F.col("maker"), F.col("notes"))})
    of = lambda cond, number, other, ref: rows.where(cond).select("pos", F.col(number).alias("number"), F.col(other).alias("other"), ref.alias("ref_number"), F.col("text").alias("notes"))
    own = lambda cond: of(cond, "number", "other", F.col("ref_number"))
    by = F.col("kind") == "superseded_by"
    streams = {
        "substitute": own(F.col("kind") == "substitute"),
        "interchange": own(F.col("kind").isin("reference", "interchange")),
        "superseding": own(F.col("kind") == "superseded_from").unionByName(of(by & F.col("other").isNotNull(), "other", "number", F.concat(F.lit(prefix), "number"))),
    }
    by_number = lambda number, id_: parts.select(F.col("number").alias(number), F.col("id").alias(id_))
    first = {name: R.first_of(df, ["number", "ref_number"], [F.col("pos")]).drop("pos") for name, df in streams.items()}
    out = {name: df.join(by_number("number", "part_id"), "number").join(by_number("other", "other_id"), "other", "left") for name, df in first.items()}
    maker = F.when(F.col("maker") != "", F.concat(F.lit(" ("), "maker", F.lit(")"))).otherwise("")
    told = rows.where(by & F.col("other").isNull()).withColumn("line", F.concat(F.lit("Superseded by: "), "ref_number", maker))
    lines = R.ordered_concat(told, ["number"], "line", "pos", "\n")
    return {"part": parts, **out, "note": lines.select("number", F.col("line").alias("notes"))}


def import_line(products: DataFrame, xrefs: DataFrame, substitutes: DataFrame, bom: DataFrame, units: DataFrame, parts: DataFrame, boms: DataFrame, known_xrefs: DataFrame, known_subs: DataFrame) -> dict[str, DataFrame]:
    """A product line by yt numbers: units, cross references, substitutes, stub parts, BOMs and items that it adds or changes.

    Blank columns of units are filled, and notes appended. A unit with a BOM of the line's name gets no other. known_xrefs and known_subs are by unit_id.
    New units and parts get ids in the order of their files, new BOMs in the order of their units' ids; what hangs on them points to them by id.
    """
    clean = products.withColumns({c: T.normalize_space(F.col(c)) for c in ("yt_number", "manufacturer", "family", "notes")}).where("yt_number <> ''")
    filled = staged_entities(clean, units, "yt_number", ["manufacturer", "family"])
    stored = units.groupBy("yt_number").agg(F.max_by("notes", "id").alias("_old"))
    noted = filled.join(R.first_of(clean, ["yt_number"], [F.col("pos")]).select("yt_number", F.col("notes").alias("_new")), "yt_number").join(stored, "yt_number", "left")
    old = F.coalesce("_old", F.lit(""))
    adds = (F.col("_new") != "") & ~old.contains(F.col("_new"))
    notes = F.when(adds, T.strip(F.concat_ws("\n", old, "_new"))).otherwise(old)
    change = F.when((F.col("change") == "kept") & adds, "updated").otherwise(F.col("change"))
    first_at = clean.groupBy("yt_number").agg(F.min("pos").alias("_pos"))
    unit = cut_lineage(noted.withColumns({"notes": notes, "change": change}).join(first_at, "yt_number").select("yt_number", "id", "manufacturer", "family", "notes", "change", "_pos"))
    unit = cut_lineage(K.with_ids(unit, units, [F.col("_pos")]).drop("_pos"))
    unit_ids = unit.select("yt_number", F.col("id").alias("unit_id"))
    names = unit.select("yt_number")
    ids = units.join(names, "yt_number", "left_semi").select(F.col("id").alias("unit_id"), "yt_number")
    found = xrefs.select("pos", T.normalize_space(F.col("our_number")).alias("yt_number"), T.normalize_space(F.col("their_number")).alias("number"), T.normalize_space(F.col("manufacturer")).alias("label"))
    xref_key = ["yt_number", "number", "label"]
    have = known_xrefs.join(ids, "unit_id").select("yt_number", F.col("cross_ref_number").alias("number"), F.col("interchange_type").alias("label"))
    xref = new_relations(found.where("number <> ''").join(names, "yt_number", "left_semi"), have, xref_key)
    subs = substitutes.select("pos", T.normalize_space(F.col("yt_number")).alias("yt_number"), T.normalize_space(F.col("substitute_yt")).alias("number")).where("number <> ''").join(names, "yt_number", "left_semi")
    have = known_subs.join(ids, "unit_id").select("yt_number", F.col("substitute_number").alias("number"))
    target = unit.select(F.col("yt_number").alias("number"), F.col("yt_number").alias("other"), F.col("id").alias("other_id"))
    substitute = new_relations(subs, have, ["yt_number", "number"]).join(target, "number", "left")
    rows = bom.withColumns({c: T.normalize_space(F.col(c)) for c in ("yt_number", "part_name", "yt_part", "jn_part")})
    stub = R.first_of(rows.where("yt_part <> ''"), ["yt_part"], [F.col("pos")])
    for column in ("yt_number", "part_number"):
        stub = stub.join(parts.where(F.col(column).isNotNull()).select(F.col(column).alias("yt_part")), "yt_part", "left_anti")
    stub = cut_lineage(K.with_ids(cut_lineage(stub.withColumn("id", F.lit(None).cast("long"))), parts, [F.col("pos")]))
    named = boms.join(ids, "unit_id").select("yt_number", "name").where(F.col("name") == F.concat("yt_number", F.lit(" BOM"))).select("yt_number")
    new_bom = cut_lineage(rows.select("yt_number").distinct().join(unit_ids, "yt_number").join(named, "yt_number", "left_anti").withColumn("id", F.lit(None).cast("long")))
    new_bom = cut_lineage(K.with_ids(new_bom, boms, [F.col("unit_id")]))
    # A part's number is its yt number, else its own; of several the highest id counts.
    numbered = [parts.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(F.col(c).alias("yt_part")).agg(F.max("id").alias(f"_{c}")) for c in ("yt_number", "part_number")]
    item = rows.where("yt_part <> ''").join(new_bom.select("yt_number", F.col("id").alias("bom_id")), "yt_number").join(numbered[0], "yt_part", "left").join(numbered[1], "yt_part", "left")
    item = item.join(stub.select("yt_part", F.col("id").alias("_stub")), "yt_part", "left").withColumn("part_id", F.coalesce("_yt_number", "_part_number", "_stub"))
    return {
        "unit": unit, "xref": xref.join(unit_ids, "yt_number").select(*xref_key, "unit_id"), "substitute": substitute.join(unit_ids, "yt_number").select("yt_number", "number", "other", "unit_id", "other_id"),
        "part": stub.select("id", F.col("yt_part").alias("number"), F.col("part_name").alias("label")),
        "bom": new_bom.select("id", "unit_id", "yt_number", F.concat("yt_number", F.lit(" BOM")).alias("label")),
        "item": item.select("pos", "yt_number", F.col("yt_part").alias("number"), F.col("part_name").alias("label"), F.col("bom_id").alias("unit_id"), F.col("part_id").alias("other_id")),
    }


def import_numbers(staged: DataFrame, refs: DataFrame, xrefs: DataFrame, known: DataFrame, identifiers: DataFrame, interchanges: DataFrame) -> dict[str, DataFrame]:
    """A catalog's parts from two staging tables, and the interchanges of its original numbers and cross references.

    refs are (pos, number, ref_number, ref_type, maker, notes), xrefs (pos, number, source_number, section, family), identifiers (identifier, id)
    of parts that one number names alone, interchanges those known, (number, ref_number). Parts only cross references name take their family, else
    section. What original numbers add is known to the cross references.
    """
    norm = lambda df, cols: df.withColumns({c: T.normalize_space(F.col(c)) for c in cols})
    detail, cross = norm(staged, ["number", "part_name", "category", "maker"]).where("number <> ''"), norm(xrefs, ["number", "source_number", "section", "family"]).where("number <> ''")
    order = F.struct("source_number", "pos")
    first_by = lambda c: F.min_by(F.col(c), F.when(F.col(c) != "", order)).alias(f"_{c}")
    meta = cross.groupBy("number").agg(first_by("family"), first_by("section"))
    one = R.first_of(detail, ["number"], [F.col("pos")]).select("number", F.lit(True).alias("_detail"), *[F.col(c).alias(f"_{c}") for c in ("part_name", "category", "maker")])
    stored = known.select("number", "id", "part_name", "category", "maker")
    every = detail.select("number").union(cross.select("number")).distinct().join(one, "number", "left").join(meta, "number", "left").join(stored, "number", "left")
    new, has = F.col("id").isNull(), F.col("_detail").isNotNull()
    or_blank = lambda *cs: F.coalesce(*[T.nullif_blank(F.col(c)) for c in cs], F.lit(""))
    category = F.when(has & new, or_blank("_category", "_family")).when(has, or_blank("_category")).otherwise(or_blank("_family", "_section"))
    name = F.when(new, or_blank("_part_name", "number")).otherwise(or_blank("part_name", "_part_name"))
    values = {"part_name": name, "category": F.coalesce(T.nullif_blank(F.col("category")), category), "maker": or_blank("maker", "_maker")}
    differs = F.lit(False)
    for c, v in values.items():
        differs = differs | (v != F.coalesce(c, F.lit("")))
    part = cut_lineage(every.select("number", "id", *[v.alias(c) for c, v in values.items()], F.when(new, "created").when(differs, "updated").otherwise("kept").alias("change")))
    have = part.select("number")
    target = identifiers.select(F.col("identifier").alias("ref_number"), F.col("id").alias("other"))
    key = ["number", "ref_number"]
    original = norm(refs, ["number", "ref_number", "ref_type", "maker", "notes"]).where("ref_number <> '' AND lower(ref_type) = 'original_number'").join(have, "number", "left_semi")
    told = F.concat(F.lit("Original number"), F.when(F.col("maker") != "", F.concat(F.lit(": "), "maker")).otherwise(""), F.when(F.col("notes") != "", F.concat(F.lit(" | "), "notes")).otherwise(""))
    first = cut_lineage(new_relations(original.withColumn("text", told), interchanges, key).join(target, "ref_number", "left").select(*key, "other", F.col("text").alias("notes")))
    rows = cross.where("source_number <> ''").withColumn("ref_number", F.col("source_number")).join(have, "number", "left_semi")
    second = new_relations(rows, interchanges.select(*key).unionByName(first.select(*key)), key).join(target, "ref_number", "left")
    return {"part": part, "detail": first, "xref": second.select(*key, "other", T.join_non_blank(" | ", F.col("section"), F.col("family")).alias("notes"))}


def copy_by_key(target: DataFrame, old: DataFrame, key: str, columns: list[str], strict: bool) -> DataFrame:
    """target with the columns of old's row of its key (the last by id); a blank there changes nothing, unless strict. Rows without a match stay."""
    last = old.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(*[F.max_by(F.coalesce(c, F.lit("")), "id").alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(last, key, "left")
    take = lambda c: F.col("_hit") & (F.lit(strict) | (F.col(f"_{c}") != ""))
    return joined.withColumns({c: F.when(F.coalesce(take(c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*target.columns)


def recategorize(parts: DataFrame, prod: DataFrame, valid: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """parts with the category that production has for their yt number, else for their part number, else by keyword; only categories of `valid` (name) are taken."""
    known = prod.where("category <> ''")
    by = lambda c: known.where(F.coalesce(c, F.lit("")) != "").groupBy(c).agg(F.max_by("category", "id").alias(f"_{c}"))
    found = parts.join(by("yt_number"), "yt_number", "left").join(by("part_number"), "part_number", "left")
    best = F.coalesce("_yt_number", "_part_number", T.mapped(F.col("category"), keywords))
    checked = found.withColumn("_best", best).join(valid.select(F.col("name").alias("_best"), F.lit(True).alias("_valid")), "_best", "left")
    return checked.withColumn("category", F.when(F.col("_valid"), F.col("_best")).otherwise(F.col("category"))).select(*parts.columns)


def replace_fields(fields: DataFrame, prod: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """fields in which each category that production has fields for has those, if the two sets differ."""
    tagged = lambda df, side: df.select(key, *columns, F.lit(side).alias("_side"))
    sides = tagged(fields, 1).unionByName(tagged(prod, 2)).groupBy(key, *columns).agg(F.count_distinct("_side").alias("_sides"))
    differ = sides.groupBy(key).agg((F.max(F.when(F.col("_sides") < 2, 1).otherwise(0)) == 1).alias("_differs"))
    has = prod.select(key).distinct().join(differ.where("_differs").select(key), key, "left_semi")
    changed = has.join(fields.select(key).distinct(), key, "left_semi")
    return K.replace_children(fields.select(key, *columns), changed, prod.join(changed, key, "left_semi").select(key, *columns), key)


def fill_oem_numbers(parts: DataFrame, interchanges: DataFrame, sources: dict[str, list[str]], links: DataFrame, owners: DataFrame, units: DataFrame) -> DataFrame:
    """parts with oem number, maker, maker's number and voltage filled where they are blank.

    The oem number is the first interchange of a source of its maker. A part without a maker takes that of its interchanges if they name one maker
    only, and its number. The maker's number is the first of the j_and_n list. Voltage comes from the first linked unit, else from the owner.
    """
    canonical = {s: maker for maker, names in sources.items() for s in names}
    named = interchanges.where("interchange_number <> ''").withColumn("maker", T.mapped(F.col("source_name"), canonical)).where("maker IS NOT NULL")
    first = named.groupBy("part_id", "maker").agg(F.min_by("interchange_number", "id").alias("number")).withColumnRenamed("part_id", "id")
    single = first.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("maker").alias("_maker"), F.min("number").alias("_only")).where("_n = 1").drop("_n")
    live = units.where("voltage <> ''").select(F.col("id").alias("unit_id"), "voltage")
    linked = links.join(live, "unit_id").groupBy(F.col("part_id").alias("id")).agg(F.min_by("voltage", "unit_id").alias("_linked"))
    owned = owners.join(live, "unit_id").groupBy(F.col("part_id").alias("id")).agg(F.min("voltage").alias("_owned"))
    joined = parts.join(first.select("id", F.col("maker").alias("oem"), F.col("number").alias("_number")), ["id", "oem"], "left").join(single, "id", "left").join(linked, "id", "left").join(owned, "id", "left")
    no_maker = F.col("oem") == ""
    number = F.when(F.col("oem_number") != "", F.col("oem_number")).when(no_maker, F.coalesce("_only", F.lit(""))).otherwise(F.coalesce("_number", F.lit("")))
    jn = T.strip(F.element_at(F.split(T.strip(F.col("j_and_n")), r" \| "), 1))
    return joined.withColumns(
        {
            "oem_number": number,
            "oem": F.when(no_maker, F.coalesce("_maker", F.lit(""))).otherwise(F.col("oem")),
            "manufacturer_number": F.when(F.col("manufacturer_number") == "", jn).otherwise(F.col("manufacturer_number")),
            "voltage": F.when(F.col("voltage") == "", F.coalesce("_linked", "_owned", F.lit(""))).otherwise(F.col("voltage")),
        }
    ).select(*parts.columns)


def cleanup_leaked_parts(parts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, items): parts whose yt number holds a leaked list deleted with their items; with only the name leaked, deleted too if they have items, else blanked."""
    leaked = lambda c: F.coalesce(F.col(c).contains("|"), F.lit(False))
    used = items.where("part_id IS NOT NULL").select(F.col("part_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    marked = cut_lineage(parts.join(used, "id", "left").withColumn("_gone", leaked("yt_number") | (leaked("part_name") & F.coalesce("_used", F.lit(False)))))
    left = K.set_where(marked.where(~F.col("_gone")), leaked("part_name"), part_name=F.lit(""), notes=F.lit(""))
    return left.select(*parts.columns), K.cascade(items, marked.where("_gone"), "part_id")


def import_components(staged: DataFrame, xrefs: DataFrame, links: DataFrame, parts: DataFrame, known: DataFrame, known_links: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
    """Components by yt number: parts created or completed, and the interchanges and unit links that they lack.

    xrefs are (pos, yt_number, number, maker), links (pos, yt_number, unit_number), known (yt_number, number, maker), known_links (yt_number, unit_id).
    """
    norm = lambda df, *cols: df.withColumns({c: T.normalize_space(F.col(c)) for c in cols})
    part = cut_lineage(staged_entities(norm(staged, "yt_number", "part_name", "category"), parts, "yt_number", ["part_name", "category"]))
    have = part.select("yt_number")
    xref = new_relations(norm(xrefs, "yt_number", "number", "maker").where("number <> ''").join(have, "yt_number", "left_semi"), known, ["yt_number", "number", "maker"])
    unit = units.where("unit_number IS NOT NULL").groupBy(T.normalize_space(F.col("unit_number")).alias("unit_number")).agg(F.max("id").alias("unit_id"))
    link = new_relations(norm(links, "yt_number", "unit_number").join(have, "yt_number", "left_semi").join(unit, "unit_number"), known_links, ["yt_number", "unit_id"])
    return {"part": part, "interchange": xref.select("yt_number", "number", "maker"), "link": link.select("yt_number", "unit_id")}


def import_by_references(staged: DataFrame, refs: DataFrame, known: DataFrame, identifiers: DataFrame, interchanges: DataFrame, source: str) -> dict[str, DataFrame]:
    """A catalog's parts, and the interchanges of all their references, with the part that a number alone names. Notes tell the source, type and number."""
    norm = lambda df, *cols: df.withColumns({c: T.normalize_space(F.col(c)) for c in cols})
    clean = norm(staged, "number", "part_name", "category", "code", "maker").withColumn("category", F.coalesce(T.nullif_blank(F.col("category")), F.col("code")))
    part = cut_lineage(staged_entities(clean, known, "number", ["part_name", "category", "maker"]))
    first = R.first_of(clean.where("number <> ''"), ["number"], [F.col("pos")]).select("number", F.coalesce(T.nullif_blank(F.col("part_name")), F.col("number")).alias("_first"))
    part = part.join(first, "number").withColumn("part_name", F.when(F.col("change") == "created", F.col("_first")).otherwise(F.col("part_name"))).drop("_first")
    rows = norm(refs, "number", "ref_number", "ref_type", "notes").where("ref_number <> ''").join(part.select("number"), "number", "left_semi")
    kind = F.lower(F.coalesce(T.nullif_blank(F.col("ref_type")), F.lit("reference")))
    told = F.concat(F.lit(f"{source} "), kind, F.lit(": "), "ref_number", F.when(F.col("notes") != "", F.concat(F.lit(" | "), "notes")).otherwise(""))
    new = new_relations(rows.withColumn("text", told), interchanges, ["number", "ref_number"])
    target = identifiers.select(F.col("identifier").alias("ref_number"), F.col("id").alias("other"))
    return {"part": part, "interchange": new.join(target, "ref_number", "left").select("number", "ref_number", "other", F.col("text").alias("notes"))}


def import_boms(products: DataFrame, rows: DataFrame, refs: DataFrame, units: DataFrame, boms: DataFrame, parts: DataFrame) -> dict[str, DataFrame]:
    """BOMs of units by their numbers: headers created or completed, items with their parts, stub parts, and labelled cross references.

    products are (name, description), rows (pos, name, text, qty, jn, oem), refs (pos, name, ref_type, maker, ref_number), units (number, id), boms (name, id, unit_id,
    description), parts (id, j_and_n, oem_number). A part is found by jn, else by oem; qty that is no number is 1.
    """
    unit = units.where("number <> ''").groupBy("number").agg(F.max("id").alias("_unit"))
    old = boms.groupBy("name").agg(F.min("id").alias("id"), F.min_by("unit_id", "id").alias("unit_id"), F.min_by("description", "id").alias("_old"))
    both = products.join(unit.withColumnRenamed("number", "name"), "name", "left").join(old, "name", "left")
    text, owner = F.coalesce(T.nullif_blank(F.col("_old")), "description", F.lit("")), F.coalesce("unit_id", "_unit")
    differs = (text != F.coalesce("_old", F.lit(""))) | (F.col("unit_id").isNull() & F.col("_unit").isNotNull())
    change = F.when(F.col("id").isNull(), "created").when(differs, "updated").otherwise("kept")
    header = cut_lineage(both.select("name", "id", owner.alias("unit_id"), text.alias("description"), change.alias("change")))
    by = lambda c: parts.where(F.coalesce(c, F.lit("")) != "").groupBy(F.col(c).alias("number")).agg(F.max("id").alias("part_id"))
    known = by("j_and_n").withColumn("by", F.lit("jn")).unionByName(by("oem_number").withColumn("by", F.lit("oem")))
    clean = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("jn", "oem", "text")}).withColumns(
        {"by": F.when(F.col("jn") != "", "jn").otherwise("oem"), "number": F.coalesce(T.nullif_blank(F.col("jn")), "oem")}
    )
    item = clean.where("number <> ''").join(header.select("name"), "name", "left_semi").join(known, ["number", "by"], "left")
    item = item.withColumn("qty", F.coalesce(F.col("qty").try_cast("int"), F.lit(1)))
    stub = R.first_of(item.where("part_id IS NULL"), ["number"], [F.col("pos")]).select("number", F.col("text").alias("label"))
    every = unit.select(F.col("number").alias("name"), F.col("_unit").alias("unit_id"))
    named = refs.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("maker", "ref_number")}).where("ref_number <> ''").join(every, "name")
    label = lambda word: F.concat(F.lit(word), F.when(F.col("maker") != "", F.concat(F.lit(": "), "maker")).otherwise(""))
    kind = F.when(F.col("ref_type") == "substitute", label("Substitute")).when(F.col("ref_type") == "superseded_by", "Superseded By").otherwise(label("Reference"))
    xref = R.first_of(named.withColumn("label", kind), ["unit_id", "ref_number", "label"], [F.col("pos")])
    xref = xref.join(unit.select(F.col("number").alias("ref_number"), F.col("_unit").alias("other")), "ref_number", "left").withColumn("other", F.nullif("other", "unit_id"))
    return {
        "bom": header, "item": item.select("pos", "name", "number", "part_id", "qty"), "part": stub,
        "xref": xref.select("unit_id", F.col("ref_number").alias("number"), "label", "other"),
    }


def _finding(df: DataFrame, category: str, field: Column, status: str, severity: str, tag: str, expected: Column | None = None, stored: Column | None = None) -> DataFrame:
    text = lambda c: F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, 500) if c is not None else F.lit("")
    return df.select(
        "unit", F.lit(category).alias("category"), field.alias("field"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit(tag).alias("tag"), text(expected).alias("expected"), text(stored).alias("stored")
    )


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def audit_attributes(expected: DataFrame, stored: DataFrame, known: Iterable[str]) -> DataFrame:
    """Findings of attributes (unit, field, value): values are alike but for case and spaces; fields that no column is known for are flagged."""
    e = expected.select("unit", "field", T.normalize_space(F.col("value")).alias("e")).where("e <> ''")
    s = stored.select("unit", "field", T.normalize_space(F.col("value")).alias("s")).where("s <> ''")
    mapped = F.col("field").isin(*known)
    same, field, e_, s_ = T.normalize_text(F.col("e")) == T.normalize_text(F.col("s")), F.col("field"), F.col("e"), F.col("s")
    have = e_.isNotNull() & s_.isNotNull()
    found = _told(e.where(mapped).join(s.where(mapped), ["unit", "field"], "full"), "ATTRIBUTE", [
        (e_.isNull(), field, "EXTRA_IN_DB", "INFO", "db_value_no_pdf_source", e_, s_), (s_.isNull(), field, "MISSING_IN_DB", "ERROR", "pdf_attr_not_imported", e_, s_),
        (have & same, field, "MATCH", "INFO", "", e_, s_), (have & ~same, field, "MISMATCH", "ERROR", "attr_value_differs", e_, s_),
    ])
    return found.unionByName(_finding(e.where(~mapped), "ATTRIBUTE", field, "FLAG", "WARN", "unmapped_attr_key", e_))


def _sided(expected: DataFrame, stored: DataFrame, key: list[str], order: list[Column], **of_key: Column) -> DataFrame:
    """The different rows of both sides, with how often each side has one (_e, _s), and with _met whether both sides have its key.

    Rows alike are counted before they move, `id` being the lowest of them; what tells of a key is a window over it. of_key are more columns of a key,
    and _first marks one row of each, a stored one if there is any, the first in order.
    """
    side = lambda df, e, s: df.withColumns({"_e": F.lit(e), "_s": F.lit(s)})
    both = side(expected, 1, 0).unionByName(side(stored, 0, 1), allowMissingColumns=True)
    ids = [F.min("id").alias("id")] if "id" in stored.columns else []
    counted = both.groupBy(*expected.columns).agg(F.sum("_e").alias("_e"), F.sum("_s").alias("_s"), *ids)
    of = Window.partitionBy(*key).orderBy((F.col("_s") == 0), *order)
    whole = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    met = known & (F.max("_e").over(whole) > 0) & (F.max("_s").over(whole) > 0)
    return counted.withColumns({"_met": met, "_first": F.row_number().over(of) == 1, **{n: c.over(whole) for n, c in of_key.items()}})


def _told(df: DataFrame, category: str, cases: list[tuple]) -> DataFrame:
    """The findings of rows in one pass: for each case (condition, field, status, severity, tag, expected, stored[, how often]) that holds."""
    text = lambda v: F.lit("") if v is None else F.substring(F.coalesce(v.cast("string"), F.lit("")), 1, 500)
    each = [
        F.when(F.coalesce(cond, F.lit(False)), F.struct("unit", F.lit(category).alias("category"), field.alias("field"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit(tag).alias("tag"), text(e).alias("expected"), text(s).alias("stored"), (n[0] if n else F.lit(1)).cast("long").alias("n")))
        for cond, field, status, severity, tag, e, s, *n in cases
    ]
    found = df.select(F.inline(F.array(*each))).where("status IS NOT NULL")
    if any(len(case) > 7 for case in cases):
        found = found.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return found.drop("n")


def audit_interchanges(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings of interchanges (unit, maker, number), each row by itself; makers are alike but for case, and several spellings of one are flagged."""
    key = ["unit", "_maker", "number"]
    norm = lambda df: df.select("unit", T.strip(F.coalesce("maker", F.lit(""))).alias("maker"), T.strip(F.coalesce("number", F.lit(""))).alias("number")).withColumn("_maker", F.lower("maker"))
    both = _sided(norm(expected), norm(stored), key, [F.col("maker")], makers=F.collect_set(F.when(F.col("_s") > 0, F.col("maker"))))
    shown, field, e, s, met = F.concat_ws(": ", "maker", "number"), F.concat_ws(":", "maker", "number"), F.col("_e"), F.col("_s"), F.col("_met")
    return _told(both, "INTERCHANGE", [
        ((e > 0) & ~met, field, "MISSING_IN_DB", "ERROR", "pdf_xref_not_in_db", shown, None, e), ((e > 0) & met, field, "MATCH", "INFO", "", shown, shown, e),
        ((s > 0) & ~met, field, "EXTRA_IN_DB", "INFO", "db_xref_not_in_pdf", None, shown, s),
        (F.col("_first") & (F.size("makers") > 1), F.concat_ws(":", "_maker", "number"), "FLAG", "ERROR", "case_variant_dupe", None, F.array_join(F.array_sort("makers"), " | "), F.lit(1)),
    ])


def audit_applications(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings of applications (unit, make, model, engine, year; stored ones with id), alike by text and by years of four digits; odd years, engines and models are flagged."""
    names = ("make", "model", "engine")
    key = ["unit", *[f"_{c}" for c in (*names, "year")]]
    norm = lambda df: df.withColumns({**{f"_{c}": T.normalize_text(F.coalesce(c, F.lit(""))) for c in names}, "_year": Y.expand_audit(F.col("year"))})
    own = T.strip(F.coalesce("year", F.lit("")))
    both = _sided(norm(expected), norm(stored), key, [F.col("id").asc_nulls_last()], years=F.collect_set(F.when(F.col("_s") > 0, own)))
    whole, named, year, e, s, met = F.concat_ws("/", *names, "year"), F.concat_ws("/", *names), F.col("year"), F.col("_e"), F.col("_s"), F.col("_met")
    flags = {
        ("year_2digit", "WARN"): year.rlike(r"^\d{2}-\d{2}$"), ("year_pipe_noise", "ERROR"): F.coalesce("year", F.lit("")).contains("|"),
        ("year_same_start_end", "WARN"): year.rlike(r"^(\d{4})-\1$"), ("line_wrap_year_in_engine", "ERROR"): F.coalesce("engine", F.lit("")).rlike(r"\d{4}-\s+\d{4}"),
        ("submodel_list_not_split", "ERROR"): T.strip(F.coalesce("model", F.lit(""))).rlike(r"^[\w./]+-[A-Z](,[A-Z])+$"),
    }
    return _told(both, "APPLICATION", [
        ((e > 0) & ~met, whole, "MISSING_IN_DB", "ERROR", "pdf_app_not_in_db", whole, None, e), ((e > 0) & met, whole, "MATCH", "INFO", "", whole, None, e),
        ((s > 0) & ~met, whole, "EXTRA_IN_DB", "INFO", "db_app_not_in_pdf", None, whole, s),
        *[((s > 0) & cond, named, "FLAG", severity, tag, None, year, s) for (tag, severity), cond in flags.items()],
        (F.col("_first") & (F.size("years") > 1), named, "FLAG", "ERROR", "year_format_dupe", F.array_join(F.array_sort("years"), " / "), None, F.lit(1)),
    ])


def audit_items(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings of BOM items (unit, number, text, jn; stored ones with id), one for each number of a unit, ignoring case: the last row counts."""
    one = lambda df, by, side: df.where(F.coalesce("number", F.lit("")) != "").groupBy("unit", F.upper("number").alias("number")).agg(F.max_by(T.strip(F.coalesce("jn", F.lit(""))), by).alias(side), F.max_by("text", by).alias(f"{side}_text"))
    both = one(expected, "pos", "e").join(one(stored, "id", "s"), ["unit", "number"], "full")
    e, s, e_text, s_text, number = F.col("e"), F.col("s"), F.col("e_text"), F.col("s_text"), F.col("number")
    have, differs = e.isNotNull() & s.isNotNull(), (e != "") & (s != "") & (T.normalize_text(e) != T.normalize_text(s))
    found = _told(both, "BOM", [
        (s.isNull(), number, "MISSING_IN_DB", "ERROR", "pdf_bom_item_missing", e_text, None), (e.isNull(), number, "EXTRA_IN_DB", "INFO", "db_bom_item_not_in_pdf", None, s_text),
        (have & differs, number, "MISMATCH", "WARN", "bom_jn_differs", e, s), (have & ~differs, number, "MATCH", "INFO", "", e_text, s_text),
    ])
    wrapped = stored.where(F.coalesce("jn", F.lit("")).rlike(r"\d-\s+\d"))
    return found.unionByName(_finding(wrapped, "BOM", number, "FLAG", "ERROR", "jn_line_wrap", None, F.col("jn")))


def audit_substitutes(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings of substitutes (unit, number), each row by itself."""
    key, shown, e, s, met = ["unit", "number"], F.col("number"), F.col("_e"), F.col("_s"), F.col("_met")
    both = _sided(expected.select(*key), stored.select("unit", T.strip(F.coalesce("number", F.lit(""))).alias("number")), key, [])
    return _told(both, "SUBSTITUTE", [
        ((e > 0) & ~met, shown, "MISSING_IN_DB", "WARN", "pdf_substitute_not_in_db", shown, None, e), ((e > 0) & met, shown, "MATCH", "INFO", "", shown, shown, e),
        ((s > 0) & ~met & (shown != ""), shown, "EXTRA_IN_DB", "INFO", "db_substitute_not_in_pdf", None, shown, s),
    ])


def audit_counts(findings: DataFrame) -> DataFrame:
    """(kind, name, n) of findings: how many of each severity, of each category and status but matches, and of each tag. Findings are counted once, by what they have in common."""
    counted = findings.groupBy("severity", "category", "status", "tag").agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(
        F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")),
        F.when(F.col("status") != "MATCH", F.struct(F.lit("issue").alias("kind"), F.concat_ws(":", "category", "status").alias("name"))),
        F.when(F.col("tag") != "", F.struct(F.lit("tag").alias("kind"), F.col("tag").alias("name"))),
    )
    return counted.select("n", F.explode(F.array_compact(rows)).alias("r")).groupBy("r.kind", "r.name").agg(F.sum("n").alias("n"))


def import_guide_xrefs(rows: DataFrame, units: DataFrame, xrefs: DataFrame) -> dict[str, DataFrame]:
    """units (id, family) and new cross references of a guide's interchanges (pos, unit_number, number, maker).

    Rows of the maker `Model Number` tell the family of a unit without one, the first of them, and are no cross references.
    """
    clean = rows.withColumns({c: T.normalize_space(F.col(c)) for c in ("unit_number", "number", "maker")}).where("number <> ''")
    number = units.where("unit_number IS NOT NULL").select(T.normalize_space(F.col("unit_number")).alias("unit_number"), F.col("id").alias("unit_id"))
    found = cut_lineage(clean.join(number, "unit_number"))
    model = F.lower("maker") == "model number"
    told = found.where(model).groupBy(F.col("unit_id").alias("id")).agg(F.min_by("number", "pos").alias("_told"))
    family = F.coalesce(T.nullif_blank(F.trim("family")), "_told", F.lit(""))
    known = xrefs.select("unit_id", F.col("cross_ref_number").alias("number"), F.col("interchange_type").alias("maker"))
    new = new_relations(found.where(~model), known, ["unit_id", "number", "maker"])
    return {"unit": units.select("id", "family").join(told, "id", "left").select("id", family.alias("family")), "xref": new.select("unit_id", "number", "maker")}


#: The steps of a star's import in their order.
STAR_STEPS = ("unit", "part", "application", "bom", "xref")


def import_star(tables: dict[str, DataFrame], lookups: dict[str, DataFrame], start: str = "unit", limit: int | None = None) -> dict[str, DataFrame]:
    """Rows of each step from `start` on, with ids replaced by the names of lookups (id, name): unit, part, application, bom, xref.

    tables are unit (pos, number, type_id, maker_id, note), part (pos, number, class, type_id, maker_id, note), application (id, make_id, model_id, engine, years, number, position),
    bom (number, part_number) and xref (pos, number, other, type_id). A number counts once. What a step needs of earlier ones is taken whether they run or
    not, as a resumed run finds them done. limit takes the first rows of each table, in its own order, for a trial.
    """
    tables = {k: df.limit(limit) if limit else df for k, df in tables.items()}
    named = lambda df, column, lookup, into: df.join(lookups[lookup].select(F.col("id").alias(column), F.col("name").alias(into)), column, "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    once = lambda df: R.first_of(df.where(text("number") != ""), ["number"], [F.col("pos")])
    unit = named(named(once(tables["unit"]), "type_id", "unit_type", "type"), "maker_id", "maker", "maker")
    unit = unit.select("number", text("type").alias("label"), text("maker").alias("maker"), F.substring(text("note"), 1, 500).alias("notes"))
    part = named(named(once(tables["part"]), "type_id", "part_type", "type"), "maker_id", "maker", "maker")
    part = part.select("number", F.coalesce(T.nullif_blank(F.col("class")), "number").alias("name"), text("type").alias("label"), text("maker").alias("maker"), text("note").alias("notes"))
    units, parts = cut_lineage(unit.select("number")), cut_lineage(part.select("number"))
    apps = named(named(tables["application"], "make_id", "make", "make"), "model_id", "model", "model")
    title = T.join_non_blank(" ", *[text(c) for c in ("make", "model", "engine", "years")])
    name = F.concat(F.coalesce(T.nullif_blank(F.substring(title, 1, 200)), F.concat(F.lit("App-"), "id")), F.lit(" [#"), "id", F.lit("]"))
    linked = apps.join(units.withColumn("linked", F.lit(True)), "number", "left")
    application = linked.select(F.col("id").cast("string").alias("number"), name.alias("name"), F.when(F.col("linked"), F.col("number")).alias("other"), F.when(F.col("linked"), F.col("position")).alias("label"))
    bom = tables["bom"].join(units, "number", "left_semi").join(parts.withColumnRenamed("number", "part_number"), "part_number", "left_semi").select("number", F.col("part_number").alias("other")).distinct()
    xref = named(tables["xref"].where((text("number") != "") & (text("other") != "")).join(units, "number", "left_semi"), "type_id", "relation", "label")
    xref = xref.select("number", "other", text("label").alias("label")).distinct().join(units.select(F.col("number").alias("other"), F.lit(True).alias("_unit")), "other", "left")
    xref = xref.select("number", "other", "label", F.coalesce(F.col("_unit") & (F.col("other") != F.col("number")), F.lit(False)).cast("string").alias("notes"))
    made = {"unit": unit, "part": part, "application": application, "bom": bom, "xref": xref}
    return {k: made[k] for k in STAR_STEPS[STAR_STEPS.index(start) :]}
