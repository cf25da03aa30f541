"""Operator 8: mix sources to target weights by Pareto order sampling.

Each source gets a target size in words.  Its documents are wanted in
proportion to a measure, here about the square root of their words: long
documents more often than short ones, yet none so often that it passes
``MOST`` copies.  A document wanted c times gives ``floor(c)`` whole copies for
certain; what is left of c is its inclusion probability for one more.

Documents are ranked by their random odds divided by their own inclusion odds,
and the sample takes them in rank order until its words reach what the whole
copies leave open (the document at the cut is in if that comes nearer).  The
random number of a document is a digest of its id and the seed, so reruns agree.

How often documents of one measure are wanted follows from sums over the
measure's values for each source: the largest ones stop at ``MOST``, the others
share the rest.  The measure is an integer of few distinct values (of the
order of a hundred for each doubling of length twice over; a text of a million
words has 16,000), so a source's values are sorted in one task whatever its
size.  The cut is found without sorting a source: ranks are counted into
``BINS`` bins (grouped sums with map-side combining), the bin of the cut is
found from these sums, and only its documents are put in order.  The result of
planning is one row for each source; applying it to documents is a join with
that table, which Spark broadcasts only if its measured size is under the
session's threshold.  Sources themselves, one row each, are sorted in one task.

Defined results: a null text has size 0; null sources are one source, last in
order.  Sources of size 0 have target 0, and documents of size 0 no copies.  A
null doc_id has its own random number and comes first among equal ranks.  Rows
that repeat a doc_id with texts of one measure share a rank and are taken or
left together.  Very long texts are counted whole.  Extra columns are kept by
``mix`` and left out of ``plan``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import WORD_REGEX, materialise

BINS = 4096
#: Copies of a document at most, and so a source's target against its size.
MOST = 2.0
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def measure_of(size: Column) -> Column:
    """The measure of a document by its words: 16 times the square root."""
    return F.floor(F.sqrt(size.cast("double")) * 16.0).cast("long")


def uniform(id_col: str, seed: int) -> Column:
    """A number strictly between 0 and 1 from the id: 52 bits of its MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, *, share: float = 1.5, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from (source, source_size).

    Targets share ``share`` times the total by weight, but stop at ``most``
    times their source's size; the excess goes to the others by weight until
    none is above.  With sources in order of size for each unit of weight, the
    stopped ones come first, so running sums give the final level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"stopped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "total": F.sum("source_size").over(all_rows) * float(share), "weights": F.sum("weight").over(all_rows)})
    # The level if exactly the sources before this one are stopped.
    rows = rows.withColumn("level", (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("gone")))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("gone"), F.col("level")))).over(all_rows)
    target = F.least("cap", F.coalesce(F.col("found.level") * F.col("weight"), F.col("cap")))
    return rows.withColumn("found", level).select("source", "source_size", target.alias("target"))


def _odds(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds."""
    return (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))


def _wanted(rows: DataFrame) -> DataFrame:
    """Adds ``whole`` copies and the chance ``part`` of one more, for rows with
    their measure and their source's ``rate``."""
    wanted = F.least(F.col("most"), F.col("rate") * F.col("measure"))
    wanted = F.when(F.col("measure") > 0, F.coalesce(wanted, F.col("most"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("wanted", wanted).withColumn("whole", F.floor("wanted").cast("long"))
    return rows.withColumn("part", F.col("wanted") - F.col("whole"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` (null where no copy is left to chance) and its bin."""
    rank = F.when(F.col("part") > 0, _odds(F.col("u"), F.col("part")))
    rows = rows.withColumn("rank", rank)
    return rows.withColumn("bin", F.floor(F.col("rank") / (F.col("rank") + 1.0) * BINS).cast("int"))


def thin(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``measure`` and the random number ``u``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"))
    return rows.withColumns({"measure": measure_of(F.col("size")), "u": uniform("doc_id", seed)})


def rates(classes: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """How many copies a unit of the measure is worth in each source, so that
    all sizes times copies give its target; null where all are wanted ``most``
    times.  ``classes``: source, measure and their words.  With the largest
    measures first, those that stop at ``most`` come first."""
    rows = _with(classes.filter("measure > 0"), wanted, "source_size", "target").filter(F.col("target") < F.lit(most) * F.col("source_size"))
    down = Window.partitionBy("source").orderBy(F.desc("measure"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    product = F.col("words").cast("decimal(38,0)") * F.col("measure")
    rest = F.sum(product.cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("rate", (F.col("target") - F.lit(most) * before.cast("double")) / rest.cast("double"))
    rows = rows.filter(F.col("rate") * F.col("measure") <= F.lit(most))
    return rows.groupBy("source").agg(F.max_by("rate", "measure").alias("rate"))


def plan(sized: DataFrame, *, share: float = 1.5, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row for each source: ``source_size``, ``target``, the ``rate`` of its
    copies, and the rank and id of the cut."""
    classes = materialise(sized.groupBy("source", "measure").agg(F.sum("size").alias("words")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    wanted = materialise(targets(sizes, share=share, most=most, weights=weights), "mix-targets")
    rate = materialise(rates(classes, wanted, most), "mix-rates")
    wanted = _with(wanted, rate, "rate").withColumn("most", F.lit(float(most)))
    certain = _wanted(_with(classes, wanted, "rate", "most")).groupBy("source").agg(F.sum(F.col("words") * F.col("whole")).alias("certain"))
    wanted = materialise(_with(wanted, certain, "certain").withColumn("open", F.col("target") - F.col("certain")).drop("certain"), "mix-wanted")

    ranked = _ranked(_wanted(_with(sized, wanted, "rate", "most", "open")))
    bins = ranked.filter("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("open").alias("open"))
    up_to = Window.partitionBy("source").orderBy("bin")
    cut = bins.withColumn("reached", F.sum("words").over(up_to)).filter(F.col("reached") >= F.col("open"))
    cut = cut.groupBy("source").agg(F.min(F.struct("bin", F.col("reached") - F.col("words"))).alias("x"))
    cut = materialise(cut.select("source", F.col("x.bin").alias("cut_bin"), F.col("x.col2").alias("before")), "mix-cuts")

    edge = _with(ranked, cut, "cut_bin", "before").filter(F.col("bin") == F.col("cut_bin"))
    # Documents of one rank and id go together, so they are summed first.
    edge = edge.groupBy("source", "rank", "doc_id").agg(F.sum("size").alias("words"), F.first("open").alias("open"), F.first("before").alias("before"))
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    edge = edge.withColumn("so_far", so_far).filter(F.col("so_far") * 2 - F.col("words") < F.col("open") * 2)
    last = edge.groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("y"))
    last = last.select("source", F.col("y.rank").alias("cut_rank"), F.col("y.doc_id").alias("cut_id"))
    out = _with(wanted, cut, "cut_bin")
    return materialise(_with(out, materialise(last, "mix-last"), "cut_rank", "cut_id"), "mix-plan")


def _with(rows: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table with one row for each source, joined on the source."""
    table = table.select(F.col("source").alias("_source"), *columns)
    return rows.join(table, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def copies(rows: DataFrame) -> Column:
    """Copies that the mix takes, for rows with their source's plan."""
    sampled = F.coalesce(
        F.when(F.col("cut_bin").isNull(), F.col("bin").isNotNull())  # every document of the sample is wanted
        .when(F.col("bin") < F.col("cut_bin"), F.lit(True))
        .when(F.col("rank") < F.col("cut_rank"), F.lit(True))
        .when((F.col("rank") == F.col("cut_rank")) & (F.coalesce(F.col("doc_id") <= F.col("cut_id"), F.col("doc_id").isNull())), F.lit(True)),
        F.lit(False),
    )
    return F.coalesce("whole", F.lit(0)) + sampled.cast("long")


_PLAN = ("source_size", "target", "rate", "most", "cut_bin", "cut_rank", "cut_id")


def decide(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``wanted`` (copies on
    average), ``copies`` and ``taken``."""
    rows = _ranked(_wanted(_with(sized, planned, *_PLAN)))
    rows = rows.withColumn("copies", copies(rows))
    return rows.select("doc_id", "size", "source_size", "target", "wanted", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def sized_table(docs: DataFrame, **columns) -> DataFrame:
    return materialise(thin(docs, **columns), "mix-sized")


def mix_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target``,
    ``wanted``, ``copies`` and ``taken`` (words that the mix takes, repeats
    counted)."""
    sized = sized_table(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    return decide(sized, plan(sized, **options)).withColumnRenamed("doc_id", id_col)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken."""
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    planned = plan(sized_table(docs, seed=seed, **names), **options)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), uniform(id_col, seed).alias("u"), measure_of(size_of(text_col)).alias("measure"))
    rows = _ranked(_wanted(_with(rows, planned, *_PLAN)))
    rows = rows.withColumn("copies", copies(rows)).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
