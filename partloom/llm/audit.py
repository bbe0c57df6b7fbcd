"""Filter interaction audit: what each filter removes at each place of every order, by a trie of permutations.

Filters that are applied one after the other leave the same rows whatever their order, so that the 120 orders of five filters
pass through 32 states only, one for each set of filters applied so far. The trie of all orders is walked depth first: a state's surviving rows are
filtered from those of the state above, persisted, and counted for every edge that leaves it; a state that was met before is
not entered again. At most one state for each filter is persisted at a time. Counts are written to the shared folder,
so that nothing of them meets at the driver, whose share is the walk.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from itertools import combinations, permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from partloom.llm.common import SPACE, cut, join_spread, let, remove, shared_folder

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filters of the contract: what a text fails by. E, copies of an earlier text, needs the whole table.
LETTERS = "ABCDE"
#: Files that a state's counts are written to at most.
FILES = 4


def failures(text: Column) -> Mapping[str, Column]:
    """Which of A to D a text fails; a null text counts as the empty one."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, SPACE, -1), "")
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))
    return {
        "words": of_words,
        "C": 100 * capitals.cast("long") > 10 * F.length(whole).cast("long"),
        "D": whole.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, n): n rows of docs of one id that fail the same filters."""
    f = failures(F.col("text"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", f["words"].alias("w"), f["C"].alias("C"), f["D"].alias("D"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"))
    rows = rows.select("doc_id", "part", "digest", (F.col("w.n") < 100).alias("A"), (100 * F.col("w.distinct").cast("long") < 80 * F.col("w.n").cast("long")).alias("B"), "C", "D")
    # Rows alike are one from here on, so that neither a text nor an id of very many rows meets in one task.
    rows = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    marked = join_spread(rows, copies, ["digest"], "n_rows", ["doc_id", "part"], "left").withColumn("E", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    alike = marked.groupBy("doc_id", "part", *LETTERS).agg(F.sum("n").alias("n"))
    known = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    every = alike.join(known, "doc_id", "left")
    return every.select("part", *LETTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def explore(rows: DataFrame, letters: Sequence[str], folder: str) -> DataFrame:
    """(part, state, kept, and for each letter removed_, good_, toxic_): what each state keeps and what each edge from it removes.

    rows has part, a boolean for each letter that says whether the row fails, good, toxic, and n, the rows it stands for. A state is the
    sorted letters of the filters applied; a part without rows in a state has no row there. The counts are written to `folder`.
    """
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    seen: set[frozenset[str]] = set()

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        seen.add(state)
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        edges = [x for x in letters if x not in state]
        counts = [F.sum("n").alias("kept")]
        for x in letters:
            hit = F.col(x) if x in edges else F.lit(False)
            counts += [total(hit).alias(f"removed_{x}"), total(hit & F.col("good")).alias(f"good_{x}"), total(hit & F.col("toxic")).alias(f"toxic_{x}")]
        held.groupBy("part").agg(*counts).withColumn("state", F.lit("".join(sorted(state)))).coalesce(FILES).write.mode("append").parquet(folder)
        for x in edges:
            if (deeper := state | {x}) not in seen:
                visit(deeper, held.where(~F.col(x)))
        held.unpersist()

    visit(frozenset(), rows)
    return rows.sparkSession.read.parquet(folder)


def interactions(rows: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """The audit of any filters over rows as explore() takes them: a row for each part, order and step."""
    states = ["".join(sorted(s)) for k in range(len(letters) + 1) for s in combinations(letters, k)]
    folder = f"{shared_folder(rows.sparkSession)}/audit-{uuid.uuid4().hex}"
    found = explore(rows, letters, folder)
    parts = found.where("state = ''").select("part", F.explode(F.array(*[F.lit(s) for s in states])).alias("state"))
    filled = cut(parts.join(found, ["part", "state"], "left").na.fill(0))
    remove(rows.sparkSession, folder)
    each = [F.struct(F.lit(x).alias("filter"), F.col(f"removed_{x}").alias("removed"), F.col(f"good_{x}").alias("good_lost"), F.col(f"toxic_{x}").alias("toxic_lost")) for x in letters]
    edges = filled.select("part", "state", F.explode(F.array(*each)).alias("e")).select("part", "state", "e.*").where(~F.col("state").contains(F.col("filter")))
    steps = [("".join(p), i + 1, p[i], "".join(sorted(p[:i])), "".join(sorted(p[: i + 1]))) for p in permutations(letters) for i in range(len(letters))]
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, state string, after string")
    grid = edges.join(F.broadcast(orders), ["state", "filter"])  # a row for each order and place, whatever the data
    alone = lambda state, name: edges.where(state).select("part", "filter", F.col("removed").alias(name))
    shapley = grid.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    facts = alone(F.col("state") == "", "failing").join(alone(F.length("state") == len(letters) - 1, "unique_fails"), ["part", "filter"]).join(shapley, ["part", "filter"])
    kept = filled.select("part", F.col("state").alias("after"), "kept")
    out = grid.join(kept, ["part", "after"]).join(facts, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The contract's five filters over docs, in all orders.

    Repeated rows count each. A null text is the empty one, a null part the empty string; a very long text counts whole. Of equal texts
    those of the smallest doc_id stay, ties included; a row without doc_id fails E never, is nobody's earlier copy, and has no labels. Where labels repeat an
    id, any 1 counts. Other columns of docs, whatever their names, are not carried. An empty table gives an empty result.
    """
    return interactions(judged(docs, labels, doc_id, text, part))
