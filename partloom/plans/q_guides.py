r"""Readers of text: wrapped lines, sections, application blocks, application lines and part numbers (H22, H23, L29, M01).

They read documents, what web pages show, and guide texts of orders; DuckDB reads the same texts with recursive queries over their lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.functions import lines as L, rules, text as T
from partloom.plans.domain import frame
from partloom.plans.registry import query, table
from partloom.sources import pages as G


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(key, text) of documents, web pages and guides, wrapped lines joined."""
    documents = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), G.html_text(F.col("html")).alias("text"))
    guides = frame(spark, sf, "guide_texts").select(F.concat(F.lit("g"), "id").alias("key"), "text")
    every = reduce(DataFrame.unionByName, [documents, pages, guides]).where("text IS NOT NULL")
    return every.select("key", L.rejoin(F.col("text")).alias("text"))


def application_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(key, text) of the application sections of guides, and of what stands under no heading."""
    found = texts(spark, sf).select("key", F.explode(G.sections(F.col("text"))).alias("s")).select("key", "s.*")
    return found.where(F.col("section").isin("", "APPLICATION")).select("key", "text")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _shown(html: str) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace({html}, '{G.HIDDEN}', '', 'g'), '{G.BREAKS}', chr(10), 'g'), '{G.TAG}', '', 'g')"
    for entity, character in G.ENTITIES.items():
        quoted = character.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return text


#: A step takes a line, or two that belong together.
_JOINED = r"""(i < len(l) AND ((regexp_matches(l[i], '\d{4}-\s*$') AND regexp_matches(l[i + 1], '^\s*\d{4}\b')) OR (regexp_matches(l[i], '\d{4}\s*$') AND regexp_matches(l[i + 1], '^\s*-\d{4}\b'))
    OR (regexp_matches(l[i], '\d-\s*$') AND regexp_matches(l[i + 1], '^\s*\d') AND length(regexp_replace(l[i], '\s+$', '')) < 30))) AS j"""
_LINES = f"""WITH RECURSIVE texts AS (SELECT 'd' || doc_id AS key, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'p' || page_id, {_shown("html")} FROM pages WHERE html IS NOT NULL
  UNION ALL SELECT 'g' || id, text FROM guide_texts),
wrapped AS (SELECT key, l, i, {_JOINED} FROM (SELECT key, string_split(text, chr(10)) AS l, 1 AS i FROM texts)
  UNION ALL SELECT key, l, i, {_JOINED} FROM (SELECT key, l, i + CASE WHEN j THEN 2 ELSE 1 END AS i FROM wrapped) WHERE i <= len(l)),
lined AS (SELECT key, i, regexp_replace(l[i], '\\s+$', '') || CASE WHEN j THEN regexp_replace(l[i + 1], '^\\s+', '') ELSE '' END AS line FROM wrapped)"""
_HEADINGS = ", ".join(f"'{h}'" for h in G.HEADINGS)
_APPLICATIONS = f"""{_LINES},
headed AS (SELECT *, CASE WHEN {_strip("line")} IN ({_HEADINGS}) THEN {_strip("line")} END AS h FROM lined),
numbered AS (SELECT *, count(h) OVER (PARTITION BY key ORDER BY i) AS n FROM headed),
named AS (SELECT *, coalesce(max(h) OVER (PARTITION BY key, n), '') AS section FROM numbered),
sections AS (SELECT key, n, list(line ORDER BY i) AS raw FROM named WHERE h IS NULL AND section IN ('', 'APPLICATION') GROUP BY key, n)"""

_TITLE = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|\\P{{L}}+)', 1), lambda t: CASE t[1] WHEN 'ß' THEN 'Ss' ELSE upper(t[1]) END || lower(t[2:])), '')"
_PLAIN = f"(NOT regexp_matches(x, '{L._YEARS}') AND NOT contains(x, ';'))"
_ATTRIBUTES = ", ".join(f"'{a}'" for a in rules.ATTRIBUTE_NAMES)
#: Applications by make, of which a step reads one line: `fm` and `ft` are what it finishes.
BLOCKS_SQL = f"""{_APPLICATIONS},
blocks AS (SELECT key, n, list_filter(list_transform(raw, lambda x: {_strip("x")}), lambda x: x <> '') AS l FROM sections
  WHERE regexp_matches(array_to_string(raw, chr(10)), '{L._YEARS}') OR NOT regexp_matches(array_to_string(raw, chr(10)), '{L._SUBSTITUTE}')),
fold AS (SELECT key, n, l, 0 AS k, '' AS make, '' AS held, false AS skip, NULL::varchar AS fm, NULL::varchar AS ft FROM blocks
  UNION ALL SELECT key, n, l, k,
    CASE kind WHEN 'bracket' THEN {_TITLE("(make || ' ' || x)")} WHEN 'wrapped' THEN make || ' ' || x WHEN 'make' THEN {_TITLE("x")} ELSE make END,
    CASE WHEN kind = 'make' AND make <> '' AND held <> '' THEN '' WHEN kind = 'model' THEN CASE WHEN held = '' THEN x ELSE held || ' ' || x END ELSE held END,
    CASE kind WHEN 'other' THEN skip WHEN 'attribute' THEN true ELSE false END,
    CASE WHEN kind = 'make' AND make <> '' AND held <> '' THEN make END, CASE WHEN kind = 'make' AND make <> '' AND held <> '' THEN held END
  FROM (SELECT *, CASE
      WHEN regexp_matches(x, '^{L._SUBSTITUTE}') OR ({_PLAIN} AND (regexp_matches(x, '^[A-Z][\\w\\s&.]*:\\s*[\\w-]+.*\\|') OR (regexp_matches(x, '\\|.*\\|') AND contains(x, ':')))) THEN 'other'
      WHEN replace(replace(lower(x), ' ', '_'), '-', '_') IN ({_ATTRIBUTES}) THEN 'attribute' WHEN skip THEN 'skipped'
      WHEN make <> '' AND held = '' AND regexp_matches(x, '^\\(.+\\)$') THEN 'bracket'
      WHEN make <> '' AND held = '' AND (regexp_matches(x, '^[-&/]') OR ({_PLAIN} AND NOT regexp_matches(x, '\\d') AND length(x) < 40)) THEN 'wrapped'
      WHEN regexp_matches(x, '^[A-Za-z]') AND {_PLAIN} AND NOT regexp_matches(x, '\\d{{2,}}[A-Z]') AND length(x) < 80 THEN 'make' ELSE 'model' END AS kind
    FROM (SELECT key, n, l, k + 1 AS k, make, held, skip, l[k + 1] AS x FROM fold WHERE k < len(l)))),
done AS (SELECT key, fm AS make, ft AS held FROM fold WHERE fm IS NOT NULL UNION ALL SELECT key, make, held FROM fold WHERE k = len(l) AND make <> '' AND held <> ''),
entries AS (SELECT key, make, {_strip("e")} AS entry FROM (SELECT key, make, unnest(string_split(held, ';')) AS e FROM done)),
dated AS (SELECT *, coalesce(list_last(regexp_extract_all(entry, '{L._YEARS}')), '') AS year FROM entries WHERE entry <> ''),
headed_entries AS (SELECT *, CASE WHEN year = '' THEN entry ELSE {_strip(f"substr(entry, 1, length(entry) - length(list_last(regexp_split_to_array(entry, '{L._YEARS}'))) - 9)")} END AS head FROM dated),
cut AS (SELECT *, list_first(regexp_split_to_array(head, '{L._ENGINE}')) AS before FROM headed_entries),
applications_read AS (SELECT key, make, substr(regexp_replace({_strip("before")}, ',+$', ''), 1, 150) AS model, substr({_strip("substr(head, length(before) + 1)")}, 1, 150) AS engine, year FROM cut)"""


@query("H22", f"{_LINES} SELECT key, string_agg(line, chr(10) ORDER BY i) AS text FROM lined GROUP BY key")
def h22(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf)


@query("H23", f"{BLOCKS_SQL} SELECT key, make, model, engine, year FROM applications_read WHERE model <> ''")
def h23(spark: SparkSession, sf: str) -> DataFrame:
    """Wrapped makes, several models, leaked lines of other sections, and prose in which short lines are taken for makes."""
    return L.application_blocks(application_texts(spark, sf), "key", "text", rules.ATTRIBUTE_NAMES)


_ENDS = f"(regexp_matches(x, '{L._YEARS}') OR x IN ({', '.join(repr(w) for w in L._EVERY_MODEL)}) OR (contains(x, ';') AND length(x) > 8))"
_MORE = f"(make = '' AND model IS NOT NULL AND ({_ENDS} OR regexp_matches(x, '^\\d{{4}}$')))"
_ENTRIES = f"""{_APPLICATIONS},
fold AS (SELECT key, n, raw AS l, 0 AS k, '' AS make, NULL::varchar AS of, NULL::varchar AS model, NULL::varchar AS fm, NULL::varchar AS ft FROM sections
  UNION ALL SELECT key, n, l, k,
    CASE WHEN {_MORE} OR {_ENDS} THEN '' WHEN make = '' THEN x ELSE make || ' ' || x END,
    CASE WHEN {_MORE} THEN of WHEN {_ENDS} THEN make ELSE of END,
    CASE WHEN {_MORE} THEN model || CASE WHEN ends_with(model, '-') THEN '' ELSE ' ' END || x WHEN {_ENDS} THEN x ELSE model END,
    CASE WHEN NOT {_MORE} AND {_ENDS} THEN of END, CASE WHEN NOT {_MORE} AND {_ENDS} THEN model END
  FROM (SELECT key, n, l, k + 1 AS k, make, of, model, {_strip("l[k + 1]")} AS x FROM fold WHERE k < len(l))),
found AS (SELECT key, fm AS make, ft AS model FROM fold WHERE ft IS NOT NULL UNION ALL SELECT key, of, model FROM fold WHERE k = len(l) AND model IS NOT NULL
  UNION ALL SELECT key, {_strip("make")}, '' FROM fold WHERE k = len(l) AND {_strip("make")} <> '')"""


@query("L29", f"""{_ENTRIES} SELECT key, make, model, coalesce(nullif(concat_ws(' - ', nullif(make, ''), nullif(model, '')), ''), 'Unknown Application') AS name,
CASE WHEN coalesce(notes, '') = '' THEN 'sheet ' || key ELSE notes || chr(10) || 'sheet ' || key END AS notes FROM found LEFT JOIN parts ON key = 'g' || id""")
def l29(spark: SparkSession, sf: str) -> DataFrame:
    """The applications in the lines of sheets, and each sheet named in the notes of its part."""
    found = application_texts(spark, sf).select("key", F.explode(L.application_lines(F.split("text", "\n"))).alias("x")).select("key", "x.*")
    name = F.coalesce(T.nullif_blank(T.join_non_blank(" - ", F.col("make"), F.col("model"))), F.lit("Unknown Application"))
    notes = frame(spark, sf, "parts").select(F.concat(F.lit("g"), "id").alias("key"), "notes")
    return found.join(notes, "key", "left").select("key", "make", "model", name.alias("name"), T.append_text(F.col("notes"), F.concat(F.lit("sheet "), "key")).alias("notes"))


def _inside(kind: str, pattern: str, least: str = "true") -> str:
    """Numbers with no letter or digit on either side; what parts them is doubled, so that neighbours do not share it."""
    doubled = "regexp_replace(line, '([^A-Z0-9*-])', '\\1\\1', 'g')"
    return f"SELECT key, '{kind}' AS kind, number FROM (SELECT key, unnest(regexp_extract_all({doubled}, '(?:^|[^A-Z0-9])({pattern})(?:[^A-Z0-9]|$)', 1)) AS number FROM lined) WHERE {least}"


@query("M01", f"""{_LINES} {_inside("jn", "[0-9]{3}-[0-9A-Z]{4,8}[*]?")} UNION ALL {_inside("metro", "[0-9]{2}-[0-9A-Z]{3,}(?:-[0-9A-Z]+)*[*]?", "regexp_matches(substr(number, 4), '[0-9]')")}
UNION ALL SELECT key, 'transpo', w FROM (SELECT key, unnest(regexp_split_to_array(line, '[\\s|,:;]+')) AS w FROM lined) WHERE regexp_matches(w, '^[A-Z0-9-]{{3,20}}$') AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[0-9]')""")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    """Part numbers of three catalogs in texts that hold others, and what only looks like them."""
    lined = texts(spark, sf).select("key", F.explode(F.split("text", "\n")).alias("line"))
    within = lambda c, kind: L.numbers_in(c, rules.NUMBER_PATTERNS[kind])
    words = F.flatten(F.transform(F.split("line", r"[\s|,:;]+"), lambda w: within(w, "transpo")))
    found = {"jn": within(F.col("line"), "jn"), "metro": within(F.col("line"), "metro"), "transpo": words}
    tagged = lambda kind: F.transform(found[kind], lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("number")))
    return lined.select("key", F.explode(F.concat(*map(tagged, found))).alias("n")).select("key", "n.*")  # texts are read once
