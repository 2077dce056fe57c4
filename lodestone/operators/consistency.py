"""How far runs and models agree: sets of objects per run, group and model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import run_parts


def objects_by_run(events: DataFrame, run: str, kind: str) -> DataFrame:
    """run, object from an event log whose ``objects`` map holds lists by kind: each pair
    once; a run without objects of the kind keeps a row with a null object."""
    e = events.select(F.explode_outer(F.col("objects")[run]).alias("run"), F.col("objects")[kind].alias("o")).where("run is not null")
    return e.select("run", F.explode_outer("o").alias("object")).distinct()


def _pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.select(*by, "run", "object").distinct()


def scores(rows: DataFrame, by: list[str], least_runs: int = 1) -> DataFrame:
    """by, runs, objects, stable, score, deviations: objects are those of any run,
    stable those of all; score is their share, 1 with fewer than two runs or without
    objects.  Rows: by, run, object; a null object keeps a run that has none, and such
    runs count.  Groups of fewer than ``least_runs`` runs are left out."""
    p = _pairs(rows, by)
    runs = p.groupBy(*by).agg(F.countDistinct("run").alias("runs"))
    per_object = p.where("object is not null").groupBy(*by, "object").agg(F.count(F.lit(1)).alias("k"))
    joined = per_object.join(runs, by)
    per = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("objects"), F.sum(F.when(F.col("k") == F.col("runs"), 1).otherwise(0)).alias("stable"))
    out = runs.join(per, by, "left")
    n, s = F.coalesce("objects", F.lit(0)), F.coalesce("stable", F.lit(0))
    return (
        out.where(F.col("runs") >= least_runs)
        .select(*by, "runs", n.alias("objects"), s.alias("stable"))
        .withColumn("score", F.when((F.col("runs") < 2) | (F.col("objects") == 0), 1.0).otherwise(F.col("stable") / F.col("objects")))
        .withColumn("deviations", F.col("objects") - F.col("stable"))
    )


def inconsistencies(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, object, present, missing: the objects that some runs lack, with the sorted
    names of the runs that have and that lack them.  The lists are as long as there
    are runs."""
    p = _pairs(rows, by)
    all_runs = p.groupBy(*by).agg(F.array_sort(F.collect_set("run")).alias("every"))
    have = p.where("object is not null").groupBy(*by, "object").agg(F.array_sort(F.collect_set("run")).alias("present"))
    return have.join(all_runs, by).withColumn("missing", F.array_except("every", "present")).where(F.size("missing") > 0).drop("every")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row on two tables of one column object: both, only_a, only_b, jaccard (1 if
    both are empty)."""
    x = a.where("object is not null").select("object").distinct().withColumn("in_a", F.lit(1))
    y = b.where("object is not null").select("object").distinct().withColumn("in_b", F.lit(1))
    j = x.join(y, "object", "full")
    both = F.coalesce(F.sum(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1).otherwise(0)), F.lit(0))
    n = F.count(F.lit(1))
    return j.agg(
        both.alias("both"), F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_b"),
        F.when(n == 0, 1.0).otherwise(both / n).alias("jaccard"),
    )


def across_models(rows: DataFrame, by: list[str], need_all: bool = False) -> DataFrame:
    """by, models, objects, overlap, only_one, jaccard over rows (by, model, object):
    what all models of a group have, what just one has, and overlap / all.  Rows with a
    null object name a model that has none; as no object is in all models then, the
    overlap is empty, whether it is compared as sets (elements) or forced to be so
    (``need_all``, edges and relationships).  Without objects the jaccard is 1."""
    p = rows.select(*by, "model", "object").distinct()
    models = p.groupBy(*by).agg(F.countDistinct("model").alias("models"))
    per = p.where("object is not null").groupBy(*by, "object").agg(F.count(F.lit(1)).alias("k"))
    g = per.join(models, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum(F.when(F.col("k") == F.col("models"), 1).otherwise(0)).alias("overlap"),
        F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("only_one"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = models.join(g, by, "left").select(*by, "models", zero("objects"), zero("overlap"), zero("only_one"))
    return out.withColumn("jaccard", F.when(F.col("objects") == 0, 1.0).otherwise(F.col("overlap") / F.col("objects")))


def stage_consistency(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, runs, variance (population), consistency: max(0, 100 - 100 * deviation / mean),
    100 with fewer than two runs or a mean of 0."""
    g = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("_s"), F.avg(value).alias("_m"))
    value_ = F.when((F.col("runs") < 2) | (F.col("_m") == 0), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("_s") / F.col("_m") * 100))
    return g.withColumn("consistency", value_).drop("_s", "_m")


def type_of(object_id: Column) -> Column:
    """The id's part before its first underscore."""
    return F.substring_index(object_id, "_", 1)


# Element types by parts and beginnings of lower-case ids, in this order.
ELEMENT_MARKS = (("component", "ac_", "ApplicationComponent"), ("service", "as_", "ApplicationService"), ("data", "do_", "DataObject"), ("artifact", "art_", "Artifact"))


def element_type_of(object_id: Column) -> Column:
    """Element type by what the id holds or begins with, else its part before the first
    underscore."""
    low, out = F.lower(object_id), None
    for part, begin, name in ELEMENT_MARKS:
        test = low.contains(part) | low.startswith(begin)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(type_of(object_id))


def by_inferred_type(rows: DataFrame, kind: Column) -> DataFrame:
    """Scores of rows (run, object) by the type that the object's id shows.  Every run
    counts for every type; with fewer than two runs there is nothing."""
    p = _pairs(rows, [])
    runs = p.agg(F.countDistinct("run").alias("runs"))
    some = p.where("object is not null").groupBy("object").agg(F.count(F.lit(1)).alias("k")).withColumn("kind", kind)
    j = some.withColumn("one", F.lit(1)).join(runs.withColumn("one", F.lit(1)), "one").where("runs >= 2")
    g = j.groupBy("kind", "runs").agg(F.count(F.lit(1)).alias("objects"), F.sum(F.when(F.col("k") == F.col("runs"), 1).otherwise(0)).alias("stable"))
    return g.withColumn("score", F.col("stable") / F.col("objects")).withColumn("deviations", F.col("objects") - F.col("stable"))


def stability_lists(rows: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """by, side (``stable`` or ``deviating``), place, object: the first ``most`` objects of
    each side in their order.  Ranks are cut within each partition before any shuffle."""
    p = _pairs(rows, by)
    runs = p.groupBy(*by).agg(F.countDistinct("run").alias("runs"))
    k = p.where("object is not null").groupBy(*by, "object").agg(F.count(F.lit(1)).alias("k")).join(runs, by)
    sided = k.select(*by, F.when(F.col("k") == F.col("runs"), "stable").otherwise("deviating").alias("side"), "object")
    return sided.withColumn("place", F.row_number().over(Window.partitionBy(*by, "side").orderBy("object"))).where(F.col("place") <= most)


def details(rows: DataFrame, kind: Column, config: str) -> DataFrame:
    """object, present, missing, consistency, present_runs, missing_runs of the objects of
    one configuration, from rows (run, object): counts, the share of runs that have it,
    and the runs' parts (session, model, repository, iteration).  Least consistent
    objects come first when ordered by ``consistency``, then object."""
    p = _pairs(rows, [])
    every = p.agg(F.array_sort(F.collect_set("run")).alias("every")).withColumn("one", F.lit(1))  # as many as there are runs
    mine = p.where("object is not null").where(kind == config).groupBy("object").agg(F.array_sort(F.collect_set("run")).alias("have")).withColumn("one", F.lit(1))
    j = mine.join(every, "one").withColumn("lack", F.array_except("every", "have"))
    parts = lambda c: F.transform(c, lambda r: run_parts(r))
    return j.select(
        "object", F.size("have").cast("bigint").alias("present"), F.size("lack").cast("bigint").alias("missing"), (F.size("have") / F.size("every")).alias("consistency"),
        parts("have").alias("present_runs"), parts("lack").alias("missing_runs"),
    )


def within_models(rows: DataFrame, runs: DataFrame, kind: str | None = None) -> DataFrame:
    """model, repository, runs, objects, stable, consistency (0 to 100), count_variance.

    rows: model, repository, run, object as the event log has them; runs: model,
    repository, run, made (how many objects the run reports), as the run table has them.
    An object is stable if as many runs have it as the run table lists; groups of fewer
    than two runs are left out; without objects the consistency is 100.  The variance is
    that of the population."""
    by = ["model", "repository"]
    n = runs.groupBy(*by).agg(F.countDistinct("run").alias("runs"), F.var_pop("made").alias("count_variance")).where("runs >= 2")
    k = rows.where("object is not null").select(*by, "run", "object").distinct().groupBy(*by, "object").agg(F.count(F.lit(1)).alias("k"))
    g = k.join(n, by).groupBy(*by).agg(F.count(F.lit(1)).alias("objects"), F.sum(F.when(F.col("k") == F.col("runs"), 1).otherwise(0)).alias("stable"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = n.join(g, by, "left").select(*by, "runs", zero("objects"), zero("stable"), "count_variance")
    out = out.withColumn("consistency", F.when(F.col("objects") == 0, 100.0).otherwise(100.0 * F.col("stable") / F.col("objects")))
    return out if kind is None else out.withColumn("kind", F.lit(kind))


def mean_consistency(within: DataFrame, by: str) -> DataFrame:
    """by, score: the mean consistency of the groups, by model or by repository."""
    return within.groupBy(F.col(by).alias("name")).agg(F.avg("consistency").alias("score"))


def localised(within: DataFrame, stages: DataFrame, kinds: DataFrame) -> DataFrame:
    """dimension, name, score (0 to 100 everywhere): mean consistency by model and by
    repository, that of each stage (stage_consistency: name, consistency), and that of
    each kind of object (scores: name, score from 0 to 1)."""
    one = lambda df, dimension: df.select(F.lit(dimension).alias("dimension"), "name", "score")
    parts = [one(mean_consistency(within, "model"), "model"), one(mean_consistency(within, "repository"), "repository")]
    parts += [one(stages.select("name", F.col("consistency").alias("score")), "stage"), one(kinds.select("name", (F.col("score") * 100).alias("score")), "object_type")]
    return reduce(DataFrame.unionByName, parts)


# The order of the groups in which weak spots are listed.
HOTSPOT_GROUPS = {"model": 1, "stage": 2, "object_type": 3}


def weak_spots(located: DataFrame, kinds: tuple[str, ...] = ("Edge", "Relationship"), below: float = 80, most: int = 10) -> DataFrame:
    """The hotspots of ``localised`` rows: models, then stages, then the named kinds of
    objects (other kinds and repositories are none)."""
    number = F.create_map(*[F.lit(x) for pair in HOTSPOT_GROUPS.items() for x in pair])[F.col("dimension")]
    some = located.where(F.col("dimension").isin("model", "stage") | (F.col("dimension") == "object_type") & F.col("name").isin(*kinds))
    return hotspots(some.select(number.alias("group_no"), "name", "score"), below, most)


def overall_of(within: DataFrame, across: DataFrame) -> DataFrame:
    """One row, overall: the mean of all consistencies and of all jaccards times 100; 100
    if there are none."""
    every = within.select(F.col("consistency").alias("x")).unionByName(across.select((F.col("jaccard") * 100).alias("x")))
    return every.agg(F.coalesce(F.avg("x"), F.lit(100.0)).alias("overall"))


def in_report_order(rows: DataFrame, by: str = "deviations") -> DataFrame:
    """Scores in the order of a report: most deviations first, least consistent first
    (``score``) or most objects first (``objects``); ties by name."""
    keys = {"deviations": F.col("deviations").desc(), "score": F.col("score").asc(), "objects": F.col("objects").desc()}
    return rows.orderBy(keys[by], "name")


def severity(score: Column) -> Column:
    return F.when(score < 50, "high").otherwise("medium")


def hotspots(groups: DataFrame, below: float = 80, most: int = 10) -> DataFrame:
    """The first ``most`` of rows (group_no, name, score) under ``below``: by group, then
    score, then name; with their severity."""
    return groups.where(F.col("score") < below).withColumn("severity", severity(F.col("score"))).orderBy("group_no", "score", "name").limit(most)


def recommendations(rows: DataFrame, name: str) -> DataFrame:
    """name, priority, advice for scores under 0.5 (HIGH) and 0.8 (MEDIUM); one row with a
    null name and the priority GOOD if there is none."""
    p = F.when(F.col("score") < 0.5, "HIGH").when(F.col("score") < 0.8, "MEDIUM")
    weak = rows.select(name, p.alias("priority"), F.concat(F.lit("agreement of "), F.col(name).cast("string"), F.lit(" is "), F.format_number(F.col("score") * 100, 1), F.lit(" %")).alias("advice")).where("priority is not null")
    none = weak.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return weak.unionByName(none.select(F.lit(None).cast(rows.schema[name].dataType).alias(name), F.lit("GOOD").alias("priority"), F.lit("all agree well").alias("advice")))


def overall(deviations: DataFrame) -> DataFrame:
    """One row: objects, deviations, overall = (objects - deviations) / objects, 1 for none."""
    return deviations.agg(F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.coalesce(F.sum("deviations"), F.lit(0)).alias("deviations")).withColumn(
        "overall", F.when(F.col("objects") == 0, 1.0).otherwise((F.col("objects") - F.col("deviations")) / F.col("objects"))
    )


def extremes(rows: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The n most and n least stable rows: name, score, side."""
    best = rows.orderBy(F.col("score").desc(), name).limit(n).select(name, "score", F.lit("most").alias("side"))
    worst = rows.orderBy(F.col("score").asc(), name).limit(n).select(name, "score", F.lit("least").alias("side"))
    return best.unionByName(worst)


def presence(rows: DataFrame, objects: list[str]) -> DataFrame:
    """object, run, present for every named object and every run."""
    runs = rows.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, objects))).alias("object"))
    have = rows.select("run", "object").distinct().withColumn("seen", F.lit(True))
    return runs.join(have, ["run", "object"], "left").select("object", "run", F.coalesce("seen", F.lit(False)).alias("present"))


def stability_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """object, change: objects stable (in all runs) on one side only: ``newly stable``
    or ``became unstable``."""

    def stable(rows: DataFrame) -> DataFrame:
        p = _pairs(rows, [])
        n = p.select("run").distinct().count()
        return p.where("object is not null").groupBy("object").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == n).select("object")

    a, b = stable(before), stable(after)
    return b.join(a, "object", "left_anti").withColumn("change", F.lit("newly stable")).unionByName(a.join(b, "object", "left_anti").withColumn("change", F.lit("became unstable")))


def stability_verdict(before: DataFrame, after: DataFrame, enough: float = 0.8) -> DataFrame:
    """One row: the shares of stable objects on both sides, and whether the later one is
    ``accepted`` (at least ``enough``), ``better`` than before, or ``worse`` or the same."""
    one = lambda rows, c: scores(rows.withColumn("g", F.lit(1)), ["g"]).select("g", F.col("score").alias(c))
    j = one(before, "before").join(one(after, "after"), "g", "full").drop("g")
    verdict = F.when(F.col("after") >= enough, "accepted").when(F.col("after") > F.col("before"), "better").otherwise("not better")
    return j.withColumn("verdict", verdict)


def latest(rows: DataFrame, order: str, n: int, key: str) -> DataFrame:
    """The n rows with the greatest ``order``, ties by key."""
    return rows.orderBy(F.col(order).desc(), key).limit(n)


def share_of_runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, object, runs, share of the group's runs that have the object."""
    p = _pairs(rows, by)
    n = p.groupBy(*by).agg(F.countDistinct("run").alias("every"))
    return p.where("object is not null").groupBy(*by, "object").agg(F.count(F.lit(1)).alias("runs")).join(n, by).withColumn("share", F.col("runs") / F.col("every")).drop("every")
