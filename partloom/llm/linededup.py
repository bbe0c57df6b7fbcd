"""Line dedup: maximal repeated runs of lines, from a suffix array over line ids and its longest common prefixes.

A document is the sequence of its lines with a word. Lines found once end every repeat, so that only runs of
repeated lines with MIN_WORDS words or more take part. Prefix doubling names the suffixes of these runs in their
order: the order by 2^(t+1) lines comes from sorting the pairs of (name by 2^t lines, name of what follows
2^t lines later) over all documents, until names reach as deep as a decision needs.

The suffix array holds each distinct suffix once, in order, with the first of its places. The longest common prefix of
neighbours cuts it into intervals: an interval of depth m is all suffixes that share their first m lines. A suffix repeats an earlier
run of m lines if its interval of depth m has an earlier place; the deepest such run, from MIN_WORDS
words on, is deleted. A suffix need not be read beyond its first line and MIN_WORDS words more: what a repeat
has beyond that is told by the suffixes of its later lines. Of equal runs the first by (doc_id, text, line) stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.llm.common import SPACE, cut, fresh, join_spread, runs

MIN_WORDS = 50
_DOC = ["dk", "doc_id", "th"]
_BLANKS = " \t\n\x0b\x0c\r"


def _ranks(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows with a number in their order: a global sort, whose partitions give the number's high bits."""
    return cut(pairs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))


def _lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    numbered = F.transform(F.split(whole, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(_BLANKS)).alias("line")))
    found = df.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"),
        F.posexplode(F.filter(numbered, lambda x: F.length(x["line"]) > 0)).alias("k", "at"),
    )
    line = F.col("at.line")
    return found.select(
        F.xxhash64("doc_id", "th").alias("dk"), "doc_id", "th", "k", F.col("at.pos").alias("pos"),
        F.size(F.split(line, SPACE, -1)).alias("words"), F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"),
    )


def _suffixes(least: int) -> object:
    """The suffixes of runs of neighbouring repeated lines with `least` words or more.

    Those that hold `least` words themselves have the line ids up to where they are read, the number of lines
    that hold `least` words, and the line numbers.
    """

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in runs(frames, "dk"):
            n = len(x)
            th, k, r, pos = (x[c].to_numpy() for c in ("th", "k", "r", "pos"))
            doc = pd.factorize(x["doc_id"], use_na_sentinel=False)[0]
            new = np.ones(n, bool)
            new[1:] = (th[1:] != th[:-1]) | (doc[1:] != doc[:-1]) | (k[1:] != k[:-1] + 1)
            first = np.flatnonzero(new)
            part = np.cumsum(new) - 1
            begin, end = first[part], np.append(first[1:], n)[part] - 1
            words = x["words"].to_numpy(np.int64)
            total = np.cumsum(words)
            enough = np.searchsorted(total, total - words + least)
            last = np.minimum(np.searchsorted(total, total + least), end)
            whole = np.flatnonzero(total[end] - total[begin] + words[begin] >= least)
            if not len(whole):
                continue
            starts = enough[whole] <= end[whole]
            spans = [(i, j + 1) if fits else None for i, j, fits in zip(whole.tolist(), last[whole].tolist(), starts.tolist(), strict=True)]
            yield x.iloc[whole][[*_DOC, "k", "r"]].assign(
                least=np.where(starts, enough[whole] - whole + 1, 0).astype(np.int32),
                ids=[None if s is None else r[s[0] : s[1]] for s in spans],
                lines=[None if s is None else pos[s[0] : s[1]] for s in spans],
            )

    return work


def common(a: list[int], b: list[int]) -> int:
    """How many items the two share from their beginning."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _sweep(ranks: Iterable[int], ids: Iterable[list[int]], before: list[int] | None, start: list[int]) -> Iterator[tuple[int, list[int]]]:
    """For suffixes in order the longest common prefix with the one before and, at depth m, where the interval of that depth starts."""
    for rank, own in zip(ranks, ids, strict=True):
        lcp = common(before, own) if before is not None else 0
        start[lcp + 1 :] = [rank] * (len(start) - lcp - 1)
        before = own
        yield lcp, start


def _ends(depth: int) -> object:
    """One row for each range of the suffix array: its first and last suffix, and where the intervals at its end start within it."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, before, start, at = None, None, [0] * (depth + 1), None
        low = depth
        for x in frames:
            ids = [v.tolist() for v in x["ids"]]
            for rank, own, (lcp, _) in zip(x["rank"].tolist(), ids, _sweep(x["rank"].tolist(), ids, before, start), strict=True):
                if head is None:
                    head, at = (rank, own), int(x["part"].iat[0])
                else:
                    low = min(low, lcp)
                before = own
        if head is not None:
            yield pd.DataFrame({"part": [at], "rank": [head[0]], "first": [head[1]], "last": [before], "low": [low], "start": [start]})

    return work


def _carried(ends: list, depth: int) -> dict[int, tuple[list[int], list[int]]]:
    """For each range the last suffix before it, and where the intervals that reach it start."""
    before, start, out = None, [0] * (depth + 1), {}
    for e in sorted(ends, key=lambda e: e["part"]):
        out[e["part"]] = (before, start)
        lcp = common(before, e["first"]) if before is not None else 0
        begun = [start[m] if m <= lcp else e["rank"] for m in range(depth + 1)]
        start = [begun[m] if m <= e["low"] else e["start"][m] for m in range(depth + 1)]
        before = e["last"]
    return out


def _intervals(carried: dict[int, tuple[list[int], list[int]]]) -> object:
    """(rank, n, doc_id, th, k, m, interval): for each suffix and depth from `least` on the interval that it lies in."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, start = None, None
        for x in frames:
            if start is None:
                before, start = carried[int(x["part"].iat[0])]
                start = list(start)
            at, depth, interval = [], [], []
            ids = [v.tolist() for v in x["ids"]]
            for i, (own, least, (_, now)) in enumerate(zip(ids, x["least"].tolist(), _sweep(x["rank"].tolist(), ids, before, start), strict=True)):
                m = range(least, len(own) + 1)
                at += [i] * len(m)
                depth += m
                interval += now[least : len(own) + 1]
            before = ids[-1] if ids else before
            yield x.iloc[at][["rank", "n", "doc_id", "th", "k"]].assign(m=np.array(depth, np.int32), interval=np.array(interval, np.int64))

    return work


def suffix_array(df: DataFrame, doc_id: str, text: str, min_words: int) -> tuple[DataFrame, DataFrame, int]:
    """(suffixes, array, depth): the suffixes that hold min_words words with their rank, and each distinct one once in order with its first place."""
    # Rows alike in id and text are one document from here on; their lines combine before they move.
    lines = cut(_lines(df, doc_id, text).dropDuplicates([*_DOC, "k"]))
    twice = _ranks(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["h1", "h2"], "r")
    active = join_spread(lines, twice, ["h1", "h2"], "n", ["dk", "k"]).drop("h1", "h2").repartition("dk")
    shape = "dk long, doc_id string, th long, k int, r long, least int, ids array<long>, lines array<int>"
    found = cut(active.withColumn("doc_id", F.col("doc_id").cast("string")).sortWithinPartitions(*_DOC, "k").mapInPandas(_suffixes(min_words), shape))
    depth = found.agg(F.max(F.size("ids"))).first()[0] or 0
    order = Window.partitionBy(*_DOC).orderBy("k")
    ranked, step = found.select(*_DOC, "k", "r"), 1
    while step < depth:
        ahead = F.when(F.lead("k", step).over(order) == F.col("k") + step, F.lead("r", step).over(order))
        paired = cut(ranked.withColumn("ahead", F.coalesce(ahead, F.lit(-1))))
        named = _ranks(paired.groupBy("r", "ahead").agg(F.count(F.lit(1)).alias("n")), ["r", "ahead"], "rank")
        ranked = join_spread(paired, named, ["r", "ahead"], "n", ["dk", "k"]).select(*_DOC, "k", F.col("rank").alias("r"))
        step *= 2
    a, b = found.where("ids IS NOT NULL").drop("r"), ranked.withColumnRenamed("r", "rank")
    same = (a["dk"] == b["dk"]) & a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"]) & (a["k"] == b["k"])
    kind = df.schema[doc_id].dataType
    suffixes = cut(a.join(b, same).select(a["doc_id"].cast(kind).alias("doc_id"), a["th"], a["k"], "rank", "least", "ids", "lines"))
    first = F.min(F.struct("doc_id", "th", "k")).alias("first")
    distinct = suffixes.groupBy("rank").agg(first, F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"), F.first("least").alias("least"))
    array = cut(distinct.repartitionByRange("rank").sortWithinPartitions("rank").withColumn("part", F.spark_partition_id()))
    return suffixes, array, depth


def repeated_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs): for each document with deleted lines its runs of line numbers, (first, last), in order and apart."""
    suffixes, array, depth = suffix_array(df, doc_id, text, min_words)
    flat = array.select("part", "rank", "n", F.col("first.doc_id").cast("string").alias("doc_id"), "first.th", "first.k", "ids", "least")
    shape = "part int, rank long, first array<long>, last array<long>, low int, start array<long>"
    ends = flat.select("part", "rank", "ids").mapInPandas(_ends(depth), shape).collect()  # a row for each range of the array
    within = flat.mapInPandas(_intervals(_carried(ends, depth)), "rank long, n long, doc_id string, th long, k int, m int, interval long")
    kind = df.schema[doc_id].dataType
    within = cut(within.select("rank", "n", F.struct(F.col("doc_id").cast(kind).alias("doc_id"), "th", "k").alias("first"), "m", "interval"))
    earliest = within.groupBy("m", "interval").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("n_rows"))
    earlier = join_spread(within, earliest, ["m", "interval"], "n_rows", ["rank"]).where(F.col("kept") < F.col("first"))
    deepest = earlier.groupBy("rank").agg(F.max("m").alias("m"))
    # The first of equal suffixes repeats what another suffix has earlier, all others repeat it whole.
    facts = array.select("rank", "first", "n").join(deepest, "rank", "left").where("n > 1 OR m IS NOT NULL")
    joined = join_spread(suffixes, facts, ["rank"], "n", ["doc_id", "th", "k"])
    m = F.when(F.struct("doc_id", "th", "k") == F.col("first"), F.col("m")).otherwise(F.size("lines"))
    later = joined.withColumn("m", m).where("m IS NOT NULL").select("doc_id", "th", F.col("lines")[0].alias("first"), F.element_at("lines", F.col("m")).alias("last"))
    by = Window.partitionBy("doc_id", "th").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = later.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by))
    merged = island.groupBy("doc_id", "th", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with the deleted lines gone from its text, and n_lines, n_deleted and deleted_runs added.

    Lines are compared without the white space around them. Lines between the first and last of a deleted run go with it,
    blank ones too. A null or empty text stays as it is; a very long one is compared whole. Rows alike in doc_id and text are one
    document, which keeps the same lines in each row; a null doc_id is an id like others and comes first. An empty table gives an empty one.
    Other columns stay, but for those named as the new ones.
    """
    rows = df.drop("n_lines", "n_deleted", "deleted_runs")
    none, id_, th, at, n = fresh(rows, "_none", "_id", "_th", "_at", "_n")
    key = [none, id_, th]
    of = lambda i: {none: i.isNull(), id_: F.coalesce(i.cast("string"), F.lit(""))}
    found = repeated_runs(rows, doc_id, text, min_words).withColumnsRenamed({"doc_id": "of", "th": th}).withColumns(of(F.col("of"))).select(*key, F.col("runs").alias("deleted_runs"))
    docs = rows.withColumns({**of(F.col(doc_id)), th: F.xxhash64(text)})
    alike = docs.groupBy(*key).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    facts = found.join(alike, key, "left").na.fill(1, [n])
    joined = join_spread(docs.withColumn(at, F.monotonically_increasing_id()), facts, key, n, [at], "left")
    gone = F.col("deleted_runs")
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.exists(gone, lambda r: (r["first"] <= i) & (i <= r["last"]))), "\n")
    n_gone = F.aggregate(gone, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)),
            "n_deleted": F.coalesce(n_gone, F.lit(0)),
            text: F.when(gone.isNotNull(), left).otherwise(F.col(text)),
        }
    ).drop(*key, at)
