"""Line-level readers of catalog text: interchange lists, wrapped lines, application blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.functions.text import strip, title_case


def interchange_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, maker, number) of `Maker: n1, n2 | Maker2: n3`; a segment without a maker takes the one before it."""
    segments = df.select(key, F.posexplode(F.split(text, r"\|")).alias("at", "segment")).withColumn("segment", strip(F.col("segment"))).where("segment <> ''")
    named = F.col("segment").contains(":")
    maker = F.when(named, strip(F.regexp_extract("segment", r"(?s)^([^:]*):(.*)$", 1)))
    numbers = F.when(named, F.regexp_extract("segment", r"(?s)^([^:]*):(.*)$", 2)).otherwise(F.col("segment"))
    above = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = segments.select(key, F.last(maker, ignorenulls=True).over(above).alias("maker"), numbers.alias("numbers"))
    return rows.where("maker <> ''").select(key, "maker", F.explode(F.split("numbers", ",")).alias("number")).withColumn("number", strip(F.col("number"))).where("number <> ''")


#: How a line ends and the next begins where a year range, its second year or a number was wrapped, and how long a number's line is at most.
_WRAPPED_YEAR = (r"\d{4}-\s*$", r"^\d{4}\b")
_WRAPPED_DASH = (r"\d{4}\s*$", r"^-\d{4}\b")
_WRAPPED_NUMBER = (r"\d-\s*$", r"^\d")
_NUMBER_LINE = 30
#: A line end after which a line may go on, and blanks before the end of a line.
_MAY_GO_ON, _BLANK_END = r"(?:\d-|\d{4})\s*[\u0085\u2028\u2029]?\n", r"[^\S\n]+(?=[\u0085\u2028\u2029]?(?:\n|\z))"


def rejoin(text: Column) -> Column:
    """Lines put together again that were wrapped within a year range or a number; a line is joined to one other at most.

    A text none of whose lines may go on, as most prose, is not taken apart.
    """

    def fold(state: Column, line: Column) -> Column:
        cur, free = state["cur"], state["free"]
        nxt = F.regexp_replace(line, r"^\s+", "")
        year, dash, number = (cur.rlike(ends) & nxt.rlike(begins) for ends, begins in (_WRAPPED_YEAR, _WRAPPED_DASH, _WRAPPED_NUMBER))
        number = number & (F.length(cur) < _NUMBER_LINE)
        join = free & (year | dash | number)
        done = F.when(join | cur.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(cur)))
        return F.struct(
            done.alias("out"),
            F.when(F.coalesce(join, F.lit(False)), F.concat(cur, nxt)).otherwise(F.regexp_replace(line, r"\s+$", "")).alias("cur"),
            (~F.coalesce(join, F.lit(False))).alias("free"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(False).alias("free"))
    end = lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))
    folded = F.array_join(F.aggregate(F.split(text, "\n"), start, fold, end), "\n")
    return F.when(text.rlike(_MAY_GO_ON), folded).otherwise(F.regexp_replace(text, _BLANK_END, ""))


#: Years of an application, and what stands for all of a make's models.
_YEARS = r"\d{4}-\d{4}"
_EVERY_MODEL = ("All Models", "Various", "Salt Spreader", "All")
#: Where a model ends and its engine begins, and a substitute's line.
_ENGINE = r"\b(?:[LVH]\d\s+\d+\.\d+L\b|\d+\.\d+L\b|Diesel\b|Turbo\b|Gas\b)"
_SUBSTITUTE = r"YouTech\s*:\s*\d{5,}"
#: A line of interchange numbers, and one that goes on with them.
_LISTED, _LISTED_ON = r"^[A-Z][\w\s&.]*:\s*[\w-]+.*\|", r"\|.*\|"
#: The longest line that is a make, and that goes on with one.
_MAKE_LINE, _MORE_MAKE = 80, 40


def _leaks(line: Column) -> Column:
    """Whether a line of applications is one of interchange numbers."""
    listed = line.rlike(_LISTED) | (line.rlike(_LISTED_ON) & line.contains(":"))
    return ~line.rlike(_YEARS) & ~line.contains(";") & listed


def _read_block(text: Column, attributes: list[str]) -> Column:
    """Structs (make, text) of a block: the makes with the text of their models, lines of other sections left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    pair = "array<struct<make:string,text:string>>"

    def flushed(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(s["make"].alias("make"), s["held"].alias("text"))))

    def state(make: Column, held: Column, out: Column, skip: Column) -> Column:
        return F.struct(make.alias("make"), held.alias("held"), out.alias("out"), skip.alias("skip"))

    def step(s: Column, line: Column) -> Column:
        no = F.lit(False)
        name = F.regexp_replace(F.regexp_replace(F.lower(line), " ", "_"), "-", "_")
        other = _leaks(line) | line.rlike(f"^{_SUBSTITUTE}")
        open_make = (s["make"] != "") & (s["held"] == "")
        bracket = open_make & line.rlike(r"^\(.+\)$")
        plain = ~line.rlike(_YEARS) & ~line.contains(";")
        wrapped = open_make & (line.rlike("^[-&/]") | (plain & ~line.rlike(r"\d") & (F.length(line) < _MORE_MAKE)))
        make = line.rlike("^[A-Za-z]") & plain & ~line.rlike(r"\d{2,}[A-Z]") & (F.length(line) < _MAKE_LINE)
        ends = (s["make"] != "") & (s["held"] != "")
        longer = F.concat(s["make"], F.lit(" "), line)
        new_make = state(title_case(line), F.when(ends, "").otherwise(s["held"]), F.when(ends, flushed(s)).otherwise(s["out"]), no)
        model = state(s["make"], F.when(s["held"] == "", line).otherwise(F.concat(s["held"], F.lit(" "), line)), s["out"], no)
        return (
            F.when(other, s)
            .when(name.isin(attributes), state(s["make"], s["held"], s["out"], F.lit(True)))
            .when(s["skip"], state(s["make"], s["held"], s["out"], no))
            .when(bracket, state(title_case(longer), s["held"], s["out"], no))
            .when(wrapped, state(longer, s["held"], s["out"], no))
            .when(make, new_make)
            .otherwise(model)
        )

    start = state(F.lit(""), F.lit(""), F.array().cast(pair), F.lit(False))
    end = lambda s: F.when((s["make"] != "") & (s["held"] != ""), flushed(s)).otherwise(s["out"])
    return F.when(~text.rlike(_YEARS) & text.rlike(_SUBSTITUTE), F.array().cast(pair)).otherwise(F.aggregate(lines, start, step, end))


def application_blocks(df: DataFrame, key: str, text: str, attributes: list[str]) -> DataFrame:
    """(key, make, model, engine, year) of application texts: lines of makes, each with entries `model engine years` that semicolons part.

    A make may go on in the next lines. The years are the rightmost of an entry. Leaked lines of interchanges and substitutes, and names of
    attributes with the line of their value, are left out; so are entries without a model.
    """
    blocks = df.select(key, F.explode(_read_block(F.col(text), attributes)).alias("b")).select(key, "b.make", F.explode(F.split("b.text", ";")).alias("entry"))
    entry = blocks.withColumn("entry", strip(F.col("entry"))).where("entry <> ''")
    years = F.regexp_extract_all("entry", F.lit(f"({_YEARS})"), F.lit(1))
    rows = entry.withColumn("year", F.when(F.size(years) > 0, F.element_at(years, -1)).otherwise(""))
    tail = F.length(F.element_at(F.split("entry", _YEARS), -1)) + 9
    head = F.when(F.col("year") == "", F.col("entry")).otherwise(strip(F.substring(F.col("entry"), F.lit(1), F.length("entry") - tail)))
    rows = rows.withColumn("head", head)
    before = F.split("head", _ENGINE, 2)[0]
    model = F.regexp_replace(strip(before), ",+$", "")
    engine = strip(F.substring(F.col("head"), F.length(before) + 1, F.length("head")))
    return rows.select(key, "make", F.substring(model, 1, 150).alias("model"), F.substring(engine, 1, 150).alias("engine"), F.substring("year", 1, 50).alias("year")).where("model <> ''")


def application_lines(lines: Column) -> Column:
    """Structs (make, model) of the lines of an application section.

    A line with years, or a word for all models, ends an entry; those before it are the make. Such a line without a make goes on with the
    model before, as does a bare year.
    """
    pair = "array<struct<make:string,model:string>>"

    def step(s: Column, raw: Column) -> Column:
        line = strip(raw)
        ends = line.rlike(_YEARS) | line.isin(*_EVERY_MODEL) | (line.contains(";") & (F.length(line) > 8))
        more = (s["make"] == "") & (F.size(s["out"]) > 0) & (ends | line.rlike(r"^\d{4}$"))
        last = F.element_at(s["out"], -1)
        joined = F.concat(last["model"], F.when(last["model"].endswith("-"), "").otherwise(" "), line)
        grown = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.struct(last["make"].alias("make"), joined.alias("model"))))
        added = F.concat(s["out"], F.array(F.struct(s["make"].alias("make"), line.alias("model"))))
        make = F.when(s["make"] == "", line).otherwise(F.concat(s["make"], F.lit(" "), line))
        state = lambda m, out: F.struct(m.alias("make"), out.alias("out"))
        return F.when(more, state(F.lit(""), grown)).when(ends, state(F.lit(""), added)).otherwise(state(make, s["out"]))

    start = F.struct(F.lit("").alias("make"), F.array().cast(pair).alias("out"))
    left = lambda s: F.struct(strip(s["make"]).alias("make"), F.lit("").alias("model"))
    return F.aggregate(lines, start, step, lambda s: F.when(strip(s["make"]) != "", F.concat(s["out"], F.array(left(s)))).otherwise(s["out"]))


def numbers_in(c: Column, pattern: str) -> Column:
    """All part numbers in a text that have the form of a catalog's."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
