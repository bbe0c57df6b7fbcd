"""Column functions on catalog text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

BLANK = r"\s+"


def nullif_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_non_blank(*cs: Column) -> Column:
    return F.coalesce(*[nullif_blank(c) for c in cs])


def strip(c: Column) -> Column:
    """Without white space around, tabs and line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANK, " "))


def normalize_text(c: Column) -> Column:
    """The form in which texts are compared loosely."""
    return F.lower(normalize_space(c))


def append_text(existing: Column, extra: Column) -> Column:
    """existing with extra as a further line, unless extra is blank or already a line of it."""
    old, new = strip(F.coalesce(existing, F.lit(""))), strip(F.coalesce(extra, F.lit("")))
    return F.when(new == "", old).when(old == "", new).when(F.array_contains(F.split(old, "\n"), new), old).otherwise(F.concat(old, F.lit("\n"), new))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first, as in `Alfa-Romeo`, `O'Neil` and `Mañana`."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def mapped(c: Column, table: dict[str, str]) -> Column:
    """table[c], null for other values."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c] if table else F.lit(None).cast("string")


def maker_name(c: Column, whitelist: dict[str, str]) -> Column:
    """A maker's name: no white space or full stops around, tokens in title case but for those whitelisted."""
    bare = strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\.+$", ""))
    token = lambda t: F.coalesce(mapped(F.upper(t), whitelist), title_case(t))
    return F.array_join(F.transform(F.filter(F.split(bare, BLANK), lambda t: t != ""), token), " ")


def renamed(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(mapped(c, table), c)


def tidy_model(c: Column) -> Column:
    """Double spaces made single and one full stop at the end dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r" {2,}", " ")), r"\.$", "")


def repair_hyphen(c: Column) -> Column:
    return F.regexp_replace(c, r"- (?=\S)", "-")


def drop_open_paren(c: Column) -> Column:
    return F.when(c.contains("(") & ~c.contains(")"), F.regexp_replace(c, r"\s*\([^)]*$", "")).otherwise(c)


def drop_page_reference(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\s+Pg\.\s*\d+\s*$", "")


def is_page_reference(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*Pg\.\s*\d+\s*$")


def annotation(c: Column) -> Column:
    """Struct (base, label) of `base (label)`, nulls if there is no annotation."""
    found = c.rlike(r"^(.+?)\s+\(([^)]+)\)(.*)$")
    part = lambda k: F.when(found, F.regexp_extract(c, r"^(.+?)\s+\(([^)]+)\)(.*)$", k))
    return F.struct(part(1).alias("base"), part(2).alias("label"))


def label_suffix(c: Column) -> Column:
    """Struct (suffix, maker) of a label that begins with a broken-off number."""
    text = strip(F.coalesce(c, F.lit("")))
    head, rest = F.regexp_extract(text, r"^([^ ]+) (.*)$", 1), strip(F.regexp_extract(text, r"^([^ ]+) (.*)$", 2))
    code = r"^[A-Z0-9][A-Z0-9-]*$"
    two = text.contains(" ") & head.rlike(code) & (F.length(head) <= 8)
    one = text.rlike(code) & (F.length(text) <= 6)
    return F.struct(
        F.when(two, head).when(one, text).otherwise("").alias("suffix"),
        F.when(two, rest).when(one, "").otherwise(text).alias("maker"),
    )


def artifact_reasons(number: Column, label: Column) -> Column:
    """Why a number looks broken, as an array of names."""
    parts = F.filter(F.split(F.regexp_replace(number, r"-+$", ""), "-"), lambda p: p != "")
    glued = F.exists(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: (i >= 2) & (i + 1 < F.size(parts)) & F.coalesce(F.get(parts, i).rlike("^[A-Za-z]$"), F.lit(False)),
    )
    tests = {
        "spaces_in_number": number.rlike(r"\s"),
        "contaminated_long": F.length(number) > 40,
        "broken_label": F.coalesce(label, F.lit("")).endswith("-"),
        "concatenated_parts": glued,
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def items(c: Column) -> Column:
    """The non-blank items of a list delimited by `|`, or by `,` if it has none."""
    cut = F.when(c.contains("|"), F.split(c, r"\|")).otherwise(F.split(c, ","))
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def first_item(c: Column) -> Column:
    return F.coalesce(F.get(items(c), F.lit(0)), F.lit(""))


def first_item_dots(c: Column) -> Column:
    """The first item, with dots if there are more."""
    return F.concat(first_item(c), F.when(F.size(items(c)) > 1, "....").otherwise(""))


def snippet(c: Column, q: str, around: int = 12) -> Column:
    """The first hit of q with up to `around` characters on each side, null without a hit."""
    at = F.locate(q.lower(), F.lower(c)) - 1
    start = F.greatest(F.lit(0), at - around)
    end = F.least(F.length(c), at + len(q) + around)
    return F.when(at >= 0, F.concat(F.lit("…"), strip(F.substring(c, start + 1, end - start)), F.lit("…")))


def first_match(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The name of the first rule of which a pattern is found, ignoring case; null if none is."""
    return F.coalesce(*[F.when(F.greatest(*[c.rlike(f"(?i){p}") for p in pats]) if len(pats) > 1 else c.rlike(f"(?i){pats[0]}"), F.lit(name)) for name, pats in rules])


def first_prefix(c: Column, table: list[tuple[str, str]]) -> Column:
    low = F.lower(strip(c))
    return F.coalesce(*[F.when(low.startswith(prefix.lower()), F.lit(name)) for prefix, name in table])


def take_token(c: Column, tokens: tuple[str, ...], sep: str = ";") -> Column:
    """Struct (token, rest): the last of the tokens in a delimited list, and the list without them."""
    parts = F.transform(F.split(c, sep), strip)
    hits = F.filter(parts, lambda p: p.isin(*tokens))
    rest = F.filter(parts, lambda p: ~p.isin(*tokens))
    blank = F.coalesce(c, F.lit("")) == ""
    return F.struct(
        F.when(blank | (F.size(hits) == 0), "").otherwise(F.element_at(hits, -1)).alias("token"),
        F.when(blank, "").otherwise(F.array_join(rest, sep)).alias("rest"),
    )


def join_non_blank(sep: str, *cs: Column) -> Column:
    return F.concat_ws(sep, *[nullif_blank(c) for c in cs])


def address(name: Column, line1: Column, line2: Column, city: Column, state: Column, zip_: Column) -> Column:
    """Lines of a bill-to block; the last is `city, state zip`."""
    region = join_non_blank(" ", state, zip_)
    return join_non_blank("\n", name, line1, line2, join_non_blank(", ", city, region))


def head_word(c: Column) -> Column:
    """What stands before the first space, without commas at its end."""
    return F.regexp_replace(F.regexp_extract(strip(c), r"^(\S*)", 1), r",+$", "")


def contains_text(c: Column, q: str) -> Column:
    """Literal substring search that ignores case: % and _ are plain characters."""
    return F.lower(c).contains(q.lower())


def any_of(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)
