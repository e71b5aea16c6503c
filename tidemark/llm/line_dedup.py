"""Removal of repeated passages of lines.

A passage is a run of lines; it counts if it has at least `min_lines` lines and `min_chars` characters. Every line belongs to the
shortest counting runs that start or end near it, and what such a run is depends on its own lines alone. A longer passage that
repeats consists of shortest runs that repeat, and they cover all its lines: so finding the repeated shortest runs finds every
repeated passage, wherever it stands and whatever is around it. Runs of one 64-bit key are then grouped by their whole text; the
first occurrence stays and the lines of the others are removed.

Only DataFrame functions are used. Texts of runs travel only where a key repeats, and copies collapse in the map tasks before. No
step gathers the occurrences of a run: they look up their group by key and digest, hot ones by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole, with_share
from tidemark.sources.stage import stage

SEP = "\n"


def with_runs(docs: DataFrame, text: Column, min_lines: int, min_chars: int) -> DataFrame:
    """`docs` with `__runs`: first line, number of lines and key of the shortest counting runs of a text.

    Where `min_lines` lines from a line on have `min_chars` characters, that is the run. Where they are too short, it is the run
    that they begin and the run that they end, as far as more lines are needed (`min_chars` + 1 at most, as line ends count).
    Every step has a column of its own that the next one reads more than once, else Spark puts its expression inside the lambda,
    where it is computed anew for every item.
    """
    goal, most = min_chars + 1, max(min_lines, min_chars + 1)
    rows = docs.withColumn("__lines", F.split(text, SEP, -1))
    rows = rows.withColumn("__hash", F.transform("__lines", lambda x: F.xxhash64(x))).withColumn("__size", F.transform("__lines", lambda x: F.char_length(x) + 1))

    def needed(sizes: Column) -> Column:
        """How many of these lines it takes, 0 if all do not do."""
        def enough(a: Column) -> Column:
            return (a["k"] >= min_lines) & (a["sum"] >= goal)

        zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("sum"))
        return F.aggregate(sizes, zero, lambda a, s: F.when(enough(a), a).otherwise(F.struct((a["k"] + 1).alias("k"), (a["sum"] + s).alias("sum"))), lambda a: F.when(enough(a), a["k"]).otherwise(0))

    def run(s: Column, k: Column) -> Column:
        return F.struct(s.cast("int").alias("s"), k.cast("int").alias("k"), F.xxhash64(F.slice("__hash", s + 1, k)).alias("key"))

    def at(_: Column, i: Column) -> Column:
        chars = sum((F.get("__size", i + d) for d in range(min_lines)), F.lit(0))  # null where the text ends before
        low, end = F.greatest(i + (min_lines - most), F.lit(0)), i + min_lines
        ahead = F.struct(F.lit(True).alias("on"), needed(F.slice("__size", i + 1, F.lit(most))).alias("k"))
        back = F.struct(F.lit(False).alias("on"), needed(F.reverse(F.slice("__size", low + 1, end - low))).alias("k"))
        longer = F.transform(F.filter(F.array(ahead, back), lambda x: x["k"] > 0), lambda x: run(F.when(x["on"], i).otherwise(end - x["k"]), x["k"]))
        return F.when(chars >= goal, F.array(run(i, F.lit(min_lines)))).when(chars.isNotNull(), longer).otherwise(F.array().cast("array<struct<s:int,k:int,key:bigint>>"))

    return rows.withColumn("__runs", F.flatten(F.transform("__hash", at))).drop("__lines", "__hash", "__size")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_chars: int = 20) -> DataFrame:
    """`docs` with the text rid of repeated passages, and the long column `removed_lines`.

    A passage counts if it has at least `min_lines` lines and `min_chars` characters, line ends between its lines included; its
    text is compared in full. Of all its occurrences the first stays: by id (null last), a hash of the text, place in the text.
    A line goes if any passage that holds it has an earlier occurrence, so each line that goes has an equal one that stays.
    Removed lines go with their line ends, and the lines that stay are joined as they were. A null text stays null; an empty one
    stays empty. Rows that repeat id and text are one document written twice and are treated alike: the second does not count as
    an occurrence. All other columns stay; a column `removed_lines` is replaced. An empty table gives no rows.
    """
    if min_lines < 1 or min_chars < 0:
        raise ValueError("min_lines must be at least 1 and min_chars at least 0")
    kept = [c for c in docs.columns if c != "removed_lines"]
    base = docs.select(*kept).withColumns({"__id": F.col(id_col).cast("long"), "__mark": F.xxhash64(whole(text_col))})
    cut = with_runs(base.select("__id", "__mark", whole(text_col).alias("t")), F.col("t"), min_lines, min_chars)
    # outer: for a plain explode Spark filters on the array's size first, and computes the runs a second time for that, all steps in one
    runs = cut.select("__id", "__mark", F.explode_outer("__runs").alias("r")).where("r IS NOT NULL").select("__id", "__mark", "r.s", "r.k", "r.key")
    runs = stage(runs, "runs")
    often = stage(runs.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "often")
    met = with_share(runs, often, ["key"], "uses", runs.count()).where("uses IS NOT NULL")
    hits = met.groupBy("__id", "__mark").agg(F.collect_set(F.struct("s", "k", "key")).alias("__hits"))

    def of_docs(table: DataFrame, own: DataFrame, how: str) -> DataFrame:
        right = own.withColumnsRenamed({"__id": "__gid", "__mark": "__gmark"})
        return table.join(right, F.col("__id").eqNullSafe(F.col("__gid")) & (F.col("__mark") == F.col("__gmark")), how).drop("__gid", "__gmark")

    texts = of_docs(base.select("__id", "__mark", whole(text_col).alias("t")), hits, "inner").withColumn("__lines", F.split("t", SEP, -1))
    bodies = F.transform("__hits", lambda h: F.struct(h["s"].alias("s"), h["k"].alias("k"), h["key"].alias("key"), F.array_join(F.slice("__lines", h["s"] + 1, h["k"]), SEP).alias("body")))
    parts = texts.withColumn("__bodies", F.when(F.size("__lines") > 0, bodies)).select("__id", "__mark", F.explode_outer("__bodies").alias("b")).select("__id", "__mark", "b.*")
    parts = parts.withColumn("digest", F.md5(F.col("body").cast("binary")))
    last = F.lit(2**63 - 1)
    place = F.struct(F.coalesce("__id", last).alias("id"), F.col("__mark").alias("mark"), F.col("s").alias("s"))
    parts = stage(parts, "parts")
    groups = parts.groupBy("key", "body").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("uses"), F.first("digest").alias("digest"))
    groups = stage(groups.where("uses > 1").select("key", "digest", "first", "uses"), "groups")
    # one text for each key and digest, as the comparison has shown; with two, they could not be told apart without the text
    names = groups.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("uses").alias("uses"))
    names = names.withColumn("first", F.when(F.col("texts") > 1, F.raise_error(F.lit("two passages share key and digest")).cast(names.schema["first"].dataType)).otherwise(F.col("first")))
    uses = parts.select("__id", "__mark", "s", "k", "key", "digest")
    met = with_share(uses, names.drop("texts"), ["key", "digest"], "uses", uses.count()).where("first IS NOT NULL")
    own = (F.coalesce("__id", last) == F.col("first.id")) & (F.col("__mark") == F.col("first.mark")) & (F.col("s") == F.col("first.s"))
    gone = met.where(~own).groupBy("__id", "__mark").agg(F.collect_set(F.struct("s", "k")).alias("__gone"))
    gone = gone.select("__id", "__mark", F.array_distinct(F.flatten(F.transform("__gone", lambda g: F.sequence(g["s"], g["s"] + g["k"] - 1)))).alias("__gone"))
    joined = of_docs(base, gone, "left")
    hit = F.col("__gone").isNotNull()
    again = joined.withColumn("__lines", F.split(F.when(hit, F.col(text_col).cast("string")).otherwise(""), SEP, -1))
    again = again.withColumn("__stay", F.when(hit, F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")))
    rest = F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), SEP)
    out = [F.when(hit, rest).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in kept]
    return again.select(*out, F.when(hit, F.size("__gone")).otherwise(0).cast("long").alias("removed_lines"))
