"""Text, year and money functions (groups H and I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from partloom.functions import lines as L, money as M, rules, text as T, years as Y
from partloom.plans import commands
from partloom.plans.domain import frame
from partloom.plans.registry import query, table

_WS = r"'\s+', ' ', 'g'"


def _first_rule(c: str, table_: list, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{n}'" for n, pats in table_ for p in pats) + f" ELSE {default} END"


_NOISY = "' ' || part_name || '  ' || chr(9) || category || ' '"


def _noisy() -> Column:
    return F.concat(F.lit(" "), "part_name", F.lit("  \t"), "category", F.lit(" "))


@query("H01", f"SELECT id, trim(regexp_replace({_NOISY}, {_WS})) AS text FROM parts")
def h01(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", T.normalize_space(_noisy()).alias("text"))


@query("H02", "SELECT id, CASE WHEN notes = '' THEN category WHEN id % 4 = 0 THEN notes ELSE notes || chr(10) || category END AS notes FROM parts")
def h02(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.when(F.col("id") % 4 == 0, F.col("notes")).otherwise(F.col("category"))
    extra = F.when(F.col("notes") == "", F.col("category")).otherwise(extra)
    return frame(spark, sf, "parts").select("id", T.append_text(F.col("notes"), extra).alias("notes"))


_TITLE = "list_reduce(list_prepend('', list_transform(regexp_extract_all({}, '([A-Za-z]+|[^A-Za-z]+)', 1), lambda p: upper(p[1]) || lower(p[2:]))), lambda a, b: a || b)"
_BARE = "regexp_replace(trim(regexp_replace(trim(interchange_type), '[.]+$', '')), '\\s+', ' ', 'g')"


@query("H03", "SELECT DISTINCT interchange_type, CASE interchange_type WHEN 'WAI' THEN 'WAI' ELSE " + _TITLE.format(_BARE) + " END AS maker FROM cross_references")
def h03(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cross_references").select("interchange_type").distinct().withColumn("maker", T.maker_name(F.col("interchange_type"), {"WAI": "WAI"}))


@query("H04", "SELECT DISTINCT trim(interchange_type) AS token FROM cross_references WHERE regexp_matches(trim(interchange_type), '^[A-Z0-9]{1,4}$') AND regexp_matches(interchange_type, '[A-Z]')")
def h04(spark: SparkSession, sf: str) -> DataFrame:
    t = F.trim("interchange_type")
    return frame(spark, sf, "cross_references").where(t.rlike("^[A-Z0-9]{1,4}$") & t.rlike("[A-Z]")).select(t.alias("token")).distinct()


@query("H05", "SELECT id, CASE manufacturer WHEN 'Leece Neville' THEN 'Leece-Neville' ELSE manufacturer END AS manufacturer FROM units")
def h05(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "units").select("id", T.renamed(F.col("manufacturer"), rules.OEM_RENAMES).alias("manufacturer"))


_MAKE = "CASE id % 4 WHEN 0 THEN 'GMC' WHEN 1 THEN 'Holland)' WHEN 2 THEN 'Teledyne -' ELSE make END"


@query("H06", f"SELECT id, CASE {_MAKE} WHEN 'GMC' THEN 'Gmc' WHEN 'Holland)' THEN 'New Holland (Sperry New Holland)' WHEN 'Teledyne -' THEN 'Teledyne' ELSE {_MAKE} END AS make FROM applications")
def h06(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").select("id", T.renamed(F.expr(_MAKE), rules.MAKE_RENAMES).alias("make"))


@query("H07", "SELECT id, regexp_replace(trim(regexp_replace(model || '   ' || engine || '.', ' {2,}', ' ', 'g')), '[.]$', '') AS model FROM applications")
def h07(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").select("id", T.tidy_model(F.concat("model", F.lit("   "), "engine", F.lit("."))).alias("model"))


@query("H08", r"SELECT id, regexp_replace(make || '- ' || model || ' - ', '- (\S)', '-\1', 'g') AS model FROM applications")
def h08(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").select("id", T.repair_hyphen(F.concat("make", F.lit("- "), "model", F.lit(" - "))).alias("model"))


@query("H09", r"SELECT id, CASE WHEN contains(cross_ref_number, '(') AND NOT contains(cross_ref_number, ')') THEN regexp_replace(cross_ref_number, '\s*\([^)]*$', '') ELSE cross_ref_number END AS number FROM cross_references")
def h09(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cross_references").select("id", T.drop_open_paren(F.col("cross_ref_number")).alias("number"))


@query("H10", r"SELECT id, regexp_replace(cross_ref_number, '(?i)\s+Pg\.\s*\d+\s*$', '') AS number FROM cross_references")
def h10(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cross_references").where(~T.is_page_reference(F.col("cross_ref_number"))).select("id", T.drop_page_reference(F.col("cross_ref_number")).alias("number"))


@query("H11", r"SELECT id, regexp_extract(cross_ref_number, '^(.+?)\s+\(([^)]+)\)(.*)$', 1) AS base, regexp_extract(cross_ref_number, '^(.+?)\s+\(([^)]+)\)(.*)$', 2) AS label FROM cross_references WHERE regexp_matches(cross_ref_number, '^(.+?)\s+\(([^)]+)\)(.*)$')")
def h11(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cross_references").withColumn("x", T.annotation(F.col("cross_ref_number"))).where("x.base IS NOT NULL").select("id", "x.base", "x.label")


@query("H12", """SELECT DISTINCT interchange_type, CASE interchange_type WHEN '10346 Ford' THEN '10346' WHEN 'ALFA ROMEO' THEN 'ALFA' WHEN 'FORD' THEN 'FORD' WHEN 'WAI' THEN 'WAI' WHEN 'BOSCH-' THEN 'BOSCH-' ELSE '' END AS suffix,
CASE interchange_type WHEN '10346 Ford' THEN 'Ford' WHEN 'ALFA ROMEO' THEN 'ROMEO' WHEN 'Alfa-romeo.' THEN 'Alfa-romeo.' ELSE '' END AS maker FROM cross_references""")
def h12(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cross_references").select("interchange_type").distinct().withColumn("x", T.label_suffix(F.col("interchange_type"))).select("interchange_type", "x.suffix", "x.maker")


@query("H13", r"""SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(n, '\s') THEN 'spaces_in_number' END, CASE WHEN length(n) > 40 THEN 'contaminated_long' END, CASE WHEN ends_with(interchange_type, '-') THEN 'broken_label' END,
CASE WHEN interchange_type = 'WAI' THEN 'concatenated_parts' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT id, interchange_type, CASE WHEN interchange_type = 'WAI' THEN 'B-X31-60-B-X33-' || cast(unit_id AS string) || '-' ELSE cross_ref_number END AS n FROM cross_references)""")
def h13(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("interchange_type") == "WAI", F.concat(F.lit("B-X31-60-B-X33-"), "unit_id", F.lit("-"))).otherwise(F.col("cross_ref_number"))
    return frame(spark, sf, "cross_references").select("id", F.array_join(T.artifact_reasons(n, F.col("interchange_type")), ",").alias("reasons"))


_LIST = "part_name || CASE id % 3 WHEN 0 THEN ' | ' || oem || '|' WHEN 1 THEN ', ' || category ELSE '' END"
_ITEMS = rf"list_filter(list_transform(CASE WHEN contains({_LIST}, '|') THEN string_split({_LIST}, '|') ELSE string_split({_LIST}, ',') END, lambda x: trim(x)), lambda x: x <> '')"


@query("H14", f"SELECT id, coalesce({_ITEMS}[1], '') AS first, len({_ITEMS}) AS n FROM parts")
def h14(spark: SparkSession, sf: str) -> DataFrame:
    c = F.expr(_LIST)
    return frame(spark, sf, "parts").select("id", T.first_item(c).alias("first"), F.size(T.items(c)).cast("long").alias("n"))


@query("H15", f"SELECT id, coalesce({_ITEMS}[1], '') || CASE WHEN len({_ITEMS}) > 1 THEN '....' ELSE '' END AS shown FROM parts")
def h15(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", T.first_item_dots(F.expr(_LIST)).alias("shown"))


@query("H16", """SELECT id, coalesce(CASE WHEN contains(lower(manufacturer_number), 'steel') THEN manufacturer_number END, CASE WHEN contains(lower(part_name), 'steel') THEN substr(part_name, 1, 50) END,
CASE WHEN contains(lower(notes), 'steel') THEN '…' || trim(substr(notes, greatest(0, strpos(lower(notes), 'steel') - 13) + 1, least(length(notes), strpos(lower(notes), 'steel') + 16) - greatest(0, strpos(lower(notes), 'steel') - 13))) || '…' END,
CASE WHEN contains(lower(voltage), 'steel') THEN 'Voltage: ' || voltage END, 'steel') AS label FROM parts""")
def h16(spark: SparkSession, sf: str) -> DataFrame:
    q = "steel"
    hit = lambda c, shown: F.when(T.contains_text(F.col(c), q), shown)
    label = F.coalesce(
        hit("manufacturer_number", F.col("manufacturer_number")), hit("part_name", F.substring("part_name", 1, 50)),
        T.snippet(F.col("notes"), q), hit("voltage", F.concat(F.lit("Voltage: "), "voltage")), F.lit(q),
    )
    return frame(spark, sf, "parts").select("id", label.alias("label"))


_PART = "CASE id % 8 WHEN 0 THEN 'Brush Holder ' WHEN 1 THEN 'solenoid REPAIR KIT ' WHEN 2 THEN 'W6000-2RS ' WHEN 3 THEN 'Drive gear ' WHEN 4 THEN 'seal ' WHEN 5 THEN 'Thru-Bolt ' WHEN 6 THEN 'diode ' ELSE '' END || part_name"


@query("H17", f"SELECT id, {_first_rule(f'({_PART})', rules.PART_CATEGORIES)} AS category, {_first_rule(f'({_PART})', rules.SHEET_CATEGORIES, repr('Uncategorized'))} AS sheet FROM parts")
def h17(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr(_PART)
    return frame(spark, sf, "parts").select("id", T.first_match(name, rules.PART_CATEGORIES).alias("category"), F.coalesce(T.first_match(name, rules.SHEET_CATEGORIES), F.lit("Uncategorized")).alias("sheet"))


_PREFIXES = [("standard", "Hardware"), ("small pl", "Plated"), ("small", "Small"), ("economy", "Economy")]


@query("H18", "SELECT id, " + "CASE " + " ".join(f"WHEN starts_with(lower(trim(category)), '{p}') THEN '{n}'" for p, n in _PREFIXES) + " ELSE category END AS category FROM parts")
def h18(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", F.coalesce(T.first_prefix(F.col("category"), _PREFIXES), "category").alias("category"))


_YT = "CASE id % 5 WHEN 0 THEN cast(400000 + id AS string) WHEN 1 THEN cast(7000000 + id AS string) ELSE yt_number END"
_GEN = ", ".join(f"'{m}'" for m in rules.GENERATOR_MAKERS)


@query("H19", f"""SELECT id, CASE WHEN upper(trim(family)) = 'TILT&TRIM' THEN 'Motor' WHEN upper(trim(family)) IN ('DD', 'PMGR') THEN 'Starter' WHEN regexp_matches({_YT}, '^[45][0-9]{{5}}$') THEN 'Generator'
WHEN regexp_matches({_YT}, '^[0-9]{{6,}}$') AND manufacturer IN ({_GEN}) THEN 'Generator' WHEN unit_type <> '' THEN unit_type WHEN manufacturer = 'Romaine Electric' THEN 'Alternator' ELSE '' END AS category FROM units""")
def h19(spark: SparkSession, sf: str) -> DataFrame:
    u = frame(spark, sf, "units").withColumn("yt_number", F.expr(_YT))
    return u.select("id", commands.unit_category(rules.GENERATOR_MAKERS).alias("category"))


@query("H20", "SELECT pos, CASE WHEN contains(options, 'Manual') THEN 'Manual' WHEN contains(options, 'Automatic') THEN 'Automatic' ELSE '' END AS token, array_to_string(list_filter(list_transform(string_split(options, ';'), lambda x: trim(x)), lambda x: x NOT IN ('Automatic', 'Manual')), ';') AS rest FROM staging_applications")
def h20(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "staging_applications").withColumn("x", T.take_token(F.col("options"), ("Automatic", "Manual"))).select("pos", "x.token", "x.rest")


_IX = "'Bosch: ' || cast(id AS string) || ', ' || manufacturer_number || ' | ' || 'A' || cast(id % 9 AS string) || ' | Lucas:' || coalesce(part_number, '')"


@query("H21", f"SELECT id, 'Bosch' AS maker, cast(id AS string) AS number FROM parts UNION ALL SELECT id, 'Bosch', manufacturer_number FROM parts UNION ALL SELECT id, 'Bosch', 'A' || cast(id % 9 AS string) FROM parts UNION ALL SELECT id, 'Lucas', part_number FROM parts WHERE part_number <> ''")
def h21(spark: SparkSession, sf: str) -> DataFrame:
    return L.interchange_pairs(frame(spark, sf, "parts").select("id", F.expr(_IX).alias("text")), "id", "text")


@query("H24", "SELECT id FROM boms WHERE contains(CASE WHEN id % 3 = 0 THEN name || '|x' ELSE name END, '|')")
def h24(spark: SparkSession, sf: str) -> DataFrame:
    leaky = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("|x"))).otherwise(F.col("name"))
    return frame(spark, sf, "boms").where(leaky.contains("|")).select("id")


@query("H25", "SELECT doc_id, substr(text, 1, 100) AS text FROM documents")
def h25(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 100).alias("text"))


@query("H26", "SELECT id, concat_ws(' ', nullif(year, ''), nullif(make, ''), nullif(model, ''), nullif(engine, '')) AS name FROM applications")
def h26(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").select("id", T.join_non_blank(" ", *[F.col(c) for c in ("year", "make", "model", "engine")]).alias("name"))


@query("H27", "SELECT id, concat_ws(chr(10), nullif(name, ''), nullif(line1, ''), nullif(line2, ''), concat_ws(', ', nullif(city, ''), concat_ws(' ', state, zip))) AS address FROM bill_to")
def h27(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "bill_to").select("id", T.address(*[F.col(c) for c in ("name", "line1", "line2", "city", "state", "zip")]).alias("address"))


@query("H28", r"SELECT id, regexp_replace(regexp_extract(part_name || ', x', '^(\S*)', 1), ',+$', '') AS head FROM parts")
def h28(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", T.head_word(F.concat("part_name", F.lit(", x"))).alias("head"))


@query("H29", f"SELECT id, lower(trim(regexp_replace({_NOISY}, {_WS}))) AS text FROM parts")
def h29(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", T.normalize_text(_noisy()).alias("text"))


_DAYS = "CASE net_terms WHEN 'NET_10' THEN 10 WHEN 'NET_30' THEN 30 WHEN 'DUE_ON_RECEIPT' THEN 0 WHEN 'CUSTOM' THEN greatest(0, net_days) ELSE 0 END"


@query("I01", f"SELECT id, {_DAYS} AS days FROM bill_to")
def i01(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "bill_to").select("id", M.term_days(F.col("net_terms"), F.col("net_days")).alias("days"))


@query("I02", f"SELECT i.id, cast(i.date + cast(CASE WHEN b.net_terms IS NULL THEN 30 ELSE {_DAYS} END AS int) AS date) AS due FROM invoices i LEFT JOIN bill_to b ON b.id = i.customer_id")
def i02(spark: SparkSession, sf: str) -> DataFrame:
    b = frame(spark, sf, "bill_to").select(F.col("id").alias("customer_id"), "net_terms", "net_days")
    due = M.due_date(F.col("date"), F.col("net_terms"), F.col("net_days"), "NET_30", 0)
    return frame(spark, sf, "invoices").select("id", "date", "customer_id").join(b, "customer_id", "left").select("id", due.alias("due"))


@query("I03", "SELECT id, cast(CASE WHEN is_tax_exempt THEN 0 ELSE coalesce(tax_rate, 6.35) END AS decimal(5,2)) AS rate FROM bill_to")
def i03(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "bill_to").select("id", M.tax_rate(F.col("is_tax_exempt"), F.col("tax_rate"), 6.35).alias("rate"))


#: Integers in millionths, rounded half to even to cents.
_UNITS = "(quantity::bigint * cast(unit_price * 100 AS bigint) * (10000 - cast(discount_pct * 100 AS bigint)))"


def _even(units: str, size: int = 10000) -> str:
    return f"cast(({units} // {size} + CASE WHEN {units} % {size} > {size // 2} OR ({units} % {size} = {size // 2} AND ({units} // {size}) % 2 = 1) THEN 1 ELSE 0 END)::decimal(16,0) * 0.01::decimal(3,2) AS decimal(12,2))"


@query("I04", f"SELECT id, {_even(_UNITS)} AS line_total FROM invoice_items")
def i04(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "invoice_items").select("id", M.line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_pct")).alias("line_total"))


@query("I05", f"""WITH s AS (SELECT invoice_id AS id, cast(sum({_even(_UNITS)}) AS decimal(14,2)) AS subtotal FROM invoice_items GROUP BY 1), c AS (SELECT *, cast(subtotal * 100 AS bigint) * 635 AS u FROM s)
SELECT id, subtotal, {_even("u")} AS tax, cast(subtotal + {_even("u")} AS decimal(14,2)) AS total FROM c""")
def i05(spark: SparkSession, sf: str) -> DataFrame:
    line = M.line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    sums = frame(spark, sf, "invoice_items").groupBy(F.col("invoice_id").alias("id")).agg(F.sum(line).cast("decimal(14,2)").alias("subtotal"))
    tax = M.round_even(F.col("subtotal") * F.lit("0.0635").cast("decimal(5,4)")).cast(M.MONEY)
    return sums.withColumn("tax", tax).withColumn("total", (F.col("subtotal") + F.col("tax")).cast("decimal(14,2)"))


@query("I06", "SELECT id, CASE WHEN cost_price > 0 AND price IS NOT NULL THEN round((price::double - cost_price::double) / cost_price::double * 100, 1) END AS margin FROM parts")
def i06(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", M.margin_pct(F.col("cost_price"), F.col("price")).alias("margin"))


@query("I07", "SELECT id, cast(cost_price * coalesce(stock_quantity, 0) AS decimal(14,2)) AS value FROM parts")
def i07(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", M.stock_value(F.col("cost_price"), F.col("stock_quantity")).alias("value"))


_CENTS = "cast(cost_price * 100 AS bigint)"


@query("I08", f"SELECT id, cast(round_even({_CENTS} / (100 - least(id % 120, CASE WHEN id % 120 >= 100 THEN 99 ELSE 100 END))::double, 2) AS decimal(12,2)) AS price FROM parts")
def i08(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", M.sell_price(F.col("cost_price"), F.col("id") % 120).alias("price"))


@query("I09", f"SELECT id, CASE WHEN id % 40 = 0 THEN NULL WHEN id % 2 = 0 THEN {_even(f'({_CENTS} * (100 + id % 40) * 100)')} ELSE cast(round_even({_CENTS} / (100.0::double * (id % 40)), 2) AS decimal(12,2)) END AS price FROM parts")
def i09(spark: SparkSession, sf: str) -> DataFrame:
    method = F.when(F.col("id") % 2 == 0, "margin").otherwise("markup")
    return frame(spark, sf, "parts").select("id", M.form_price(F.col("cost_price"), method, F.col("id") % 40).alias("price"))


@query("I10", "SELECT id, coalesce(nullif(rebuilt_unit_price, 0), nullif(new_unit_price, 0), 0)::decimal(10,2) AS price FROM units")
def i10(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "units").select("id", M.unit_price(F.col("rebuilt_unit_price"), F.col("new_unit_price")).alias("price"))


@query("I11", "SELECT id, CASE WHEN id % 100 <= 29 THEN '20' ELSE '19' END || lpad(cast(id % 100 AS string), 2, '0') AS year FROM parts")
def i11(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", Y.expand_search(F.lpad((F.col("id") % 100).cast("string"), 2, "0")).alias("year"))


_END = "CASE WHEN regexp_matches(y, '^[0-9]{2}$') THEN CASE WHEN try_cast(y AS int) <= 30 THEN '20' || y ELSE '19' || y END ELSE y END"


@query("I12", f"SELECT id, array_to_string(list_transform(string_split(year, ' | '), lambda p: array_to_string(list_transform(string_split(p, '-'), lambda y: {_END}), '-')), ' | ') AS year FROM applications")
def i12(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").select("id", Y.expand_import(F.col("year")).alias("year"))


_AB = "try_cast(substr(year, 1, 2) AS int) AS a, try_cast(substr(year, 4, 2) AS int) AS b, regexp_matches(year, '^[0-9]{2}-[0-9]{2}$') AS short"
_ONE = "CASE WHEN {} >= 70 THEN '19' ELSE '20' END || lpad(cast({} AS string), 2, '0')"


@query("I13", f"""SELECT id, CASE WHEN NOT short THEN year WHEN a > b THEN {_ONE.format("a", "a")} || '-' || {_ONE.format("b", "b")}
ELSE {_ONE.format("greatest(a, b)", "a")} || '-' || {_ONE.format("greatest(a, b)", "b")} END AS year FROM (SELECT id, year, {_AB} FROM applications)""")
def i13(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").select("id", Y.expand_range(F.col("year")).alias("year"))


@query("I14", f"""SELECT id, CASE WHEN NOT short THEN year ELSE {_ONE.format("a", "a")} || '-' || {_ONE.format("b", "b")} END AS year FROM (SELECT id, year, {_AB} FROM applications)""")
def i14(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").select("id", Y.expand_audit(F.col("year")).alias("year"))


@query("I15", "SELECT id, CASE WHEN regexp_matches(year, '^[0-9]{4}-[0-9]{4}$') AND substr(year, 1, 4) > substr(year, 6, 4) THEN substr(year, 6, 4) || '-' || substr(year, 1, 4) ELSE year END AS year FROM applications")
def i15(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").select("id", Y.fix_direction(F.col("year")).alias("year"))


@query("I16", "SELECT id, (date + 30 < date '1997-01-01' AND status IN ('DRAFT', 'SENT')) AS overdue FROM invoices")
def i16(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "invoices").select("id", M.overdue(F.date_add("date", 30), F.col("status"), F.lit("1997-01-01").cast("date")).alias("overdue"))


@query("I17", "SELECT id FROM invoices WHERE date + 30 BETWEEN date '1997-01-01' AND date '1997-01-08'")
def i17(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "invoices").where(M.due_soon(F.date_add("date", 30), F.lit("1997-01-01").cast("date"))).select("id")


def next_number(invoices: DataFrame, prefix: str, padding: int) -> DataFrame:
    """The number after the greatest one, as text, that starts with prefix; numbers past the padding sort below shorter ones."""
    last = invoices.where(F.col("invoice_number").startswith(prefix)).agg(F.max("invoice_number").alias("last"))
    seq = F.coalesce(F.substring("last", len(prefix) + 1, 20).try_cast("int"), F.lit(0)) + 1
    return last.select(F.concat(F.lit(prefix), F.when(F.length(seq.cast("string")) < padding, F.lpad(seq.cast("string"), padding, "0")).otherwise(seq.cast("string"))).alias("number"))


@query("I18", "SELECT 'INV-' || CASE WHEN n < 10000 THEN lpad(cast(n AS string), 4, '0') ELSE cast(n AS string) END AS number FROM (SELECT coalesce(try_cast(substr(max(invoice_number), 5) AS int), 0) + 1 AS n FROM invoices WHERE starts_with(invoice_number, 'INV-'))")
def i18(spark: SparkSession, sf: str) -> DataFrame:
    return next_number(frame(spark, sf, "invoices"), "INV-", 4)


@query("I19", "SELECT id, CASE WHEN id % 3 = 0 THEN 'soon' ELSE strftime(date, '%b %d, %Y') END AS shown FROM invoices")
def i19(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("id") % 3 == 0, "soon").otherwise(F.col("date").cast("string"))
    return frame(spark, sf, "invoices").select("id", F.coalesce(F.date_format(F.try_to_date(raw, "yyyy-MM-dd"), "MMM dd, yyyy"), raw).alias("shown"))


@query("I20", "SELECT id, try_cast(CASE WHEN id % 3 = 0 THEN 'n/a' ELSE cast(id AS string) || '.25' END AS decimal(10,2)) AS price, coalesce(try_cast(CASE WHEN id % 4 = 0 THEN '' ELSE cast(id AS string) END AS int), 0) AS qty FROM parts")
def i20(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("id") % 3 == 0, "n/a").otherwise(F.concat("id", F.lit(".25")))
    qty = F.when(F.col("id") % 4 == 0, "").otherwise(F.col("id").cast("string"))
    return frame(spark, sf, "parts").select("id", M.lenient_decimal(price).alias("price"), M.lenient_int(qty).alias("qty"))
