"""Which file a path in code means, which files belong together, and what each is for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.sources.scratch import written

#: Columns of an evaluation report and of a table of importances, as squeezed names.
REPORT_COLUMNS = ("precision", "recall", "f1score", "support")
WEIGHT_COLUMNS = ("importance", "featureimportance", "gain", "weight")
FEATURE_COLUMNS = ("feature", "featurename", "variable", "column")
#: Words of a path, between separators, that name a split.
SPLIT_WORDS = {"train": ("train",), "test": ("test",), "validation": ("validation", "valid", "val")}
#: Rows of an evaluation report at most.
REPORT_ROWS = 50


def resolve_paths(reads: DataFrame, files: DataFrame) -> DataFrame:
    """(code, path, file, how) for ``reads`` (code, path) against ``files`` (file).

    A path means the file of exactly that name from the root or beside the code; else the only
    file that ends with it, for a relative path of several parts; else the only file of its base
    name.  Several candidates are ambiguous and resolve to none: a guess is never made.  Paths are
    :func:`normal_path` first, and a file inside an archive (before ``!/``) is only met by code of the
    same archive.
    """
    reads = reads.select("code", normal_path(F.col("path")).alias("path"))
    folder = F.regexp_extract("code", "^(.*)/[^/]*$", 1)
    inside = F.regexp_extract("code", "^(.*!/)", 1)
    reads = reads.select("code", "path", inside.alias("inside"), F.concat(inside, "path").alias("whole"), normal_path(F.when(folder == "", F.col("path")).otherwise(F.concat_ws("/", folder, F.col("path")))).alias("beside"))
    base = F.regexp_extract("path", "([^/]*)$", 1)
    relative = F.contains(F.col("path"), F.lit("/")) & ~F.col("path").startswith("/") & ~F.contains(F.col("path"), F.lit("://")) & ~F.col("path").rlike("^[A-Za-z]:/")
    named = files.select("file", F.regexp_extract("file", "([^/]*)$", 1).alias("base"), F.regexp_extract("file", "^(.*!/)", 1).alias("file_inside"))
    # whatever tier applies, the file has the base name of the path: one equi-join finds them all
    met = reads.withColumns({"base": base, "relative": relative}).join(named, "base", "left")
    met = met.withColumn("file", F.when(F.col("inside") == F.col("file_inside"), F.col("file")))
    tier = (
        F.when(F.col("file").isin(F.col("whole"), F.col("beside")), 1)
        .when(F.col("relative") & (F.col("file").endswith(F.concat(F.lit("/"), F.col("path")))), 2)
        .when(~F.col("relative") & F.col("file").isNotNull(), 3)
    )
    best = met.withColumn("tier", tier).groupBy("code", "path").agg(
        F.min("tier").alias("best"), F.collect_set(F.when(F.col("tier") == 1, F.col("file"))).alias("t1"), F.collect_set(F.when(F.col("tier") == 2, F.col("file"))).alias("t2"), F.collect_set(F.when(F.col("tier") == 3, F.col("file"))).alias("t3")
    )
    candidates = F.when(F.col("best") == 1, F.col("t1")).when(F.col("best") == 2, F.col("t2")).when(F.col("best") == 3, F.col("t3"))
    how = F.when(F.col("best").isNull(), "not_imported").when(F.size(candidates) > 1, "ambiguous_path").otherwise(F.element_at(F.array(F.lit("explicit_path"), F.lit("project_relative_suffix"), F.lit("unique_basename")), F.col("best")))
    return best.select("code", "path", F.when(F.size(candidates) == 1, candidates[0]).alias("file"), how.alias("how"))


def normal_path(path: Column) -> Column:
    """The path with plain slashes, without empty and dot parts, and with ``..`` undone where a part
    stands before it; null where it is empty or holds a NUL."""
    plain = F.translate(path, "\\", "/")
    rooted = F.when(plain.startswith("/"), "/").otherwise("")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(back, F.slice(done, 1, F.size(done) - 1)).when((part == "..") & (rooted == "/"), done).otherwise(F.concat(done, F.array(part)))

    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    # two slashes of a scheme stay
    named = F.when(plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), plain).otherwise(F.concat(rooted, joined))
    return F.when((path != "") & ~F.contains(path, F.lit("\x00")), F.when(named == "", ".").otherwise(named))


def bound_flows(reads: DataFrame, flows: DataFrame) -> DataFrame:
    """(dataset, flow, how) for the datasets that ``reads`` (code, dataset, replay_safe) name: the one
    flow of ``flows`` (flow, code, signature) whose code reads this dataset only, and safely.  Flows of
    one signature are one, told by the first; several different ones leave the dataset unbound."""
    single = reads.groupBy("code").agg(F.min("dataset").alias("dataset"), F.max("dataset").alias("last"), F.bool_and("replay_safe").alias("safe")).where("dataset = last and safe")
    met = single.join(flows, "code").groupBy("dataset", "signature").agg(F.min("flow").alias("flow"))
    chosen = met.groupBy("dataset").agg(F.count("*").alias("n"), F.min("flow").alias("flow"))
    how = F.when(F.col("n").isNull(), "unassociated").when(F.col("n") > 1, "several_flows").otherwise("matched")
    return reads.select("dataset").distinct().join(chosen, "dataset", "left").select("dataset", F.when(F.col("n") == 1, F.col("flow")).alias("flow"), how.alias("how"))


def lineage_edges(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(parent, child, code): what a code unit writes comes from what it reads."""
    r = reads.where("file is not null").select("code", F.col("file").alias("parent")).distinct()
    w = writes.where("file is not null").select("code", F.col("file").alias("child")).distinct()
    return r.join(w, "code").where("parent <> child").select("parent", "child", "code")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node of an undirected edge list.

    Minimum labels travel along the edges, and along the labels themselves, so the number of
    rounds is about the logarithm of the longest path.  Each round's labels are written to the
    folder in ``spark.checkpoint.dir``."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).where("u is not null and v is not null").distinct()
    both = written(both, "edges")
    label = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("near"))
        far = label.select(F.col("u").alias("l"), F.col("l").alias("far"))
        new = label.join(near, "u").join(far, "l", "left").select("u", F.least("l", "near", "far").alias("m"), "l")
        new = written(new, "labels")
        if new.where("m <> l").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("m").alias("component"))
        label = new.select("u", F.col("m").alias("l"))


def dataset_role(path: Column, columns: Column, rows: Column, derived: Column) -> Column:
    """struct(role, confidence) from a file's path, its column names, its rows, and whether code
    that was read writes it.  Results of a model come first, then the split that the path names,
    then what code has made, then raw data."""
    squeezed = F.transform(columns, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""))
    place = F.translate(F.lower(path), "\\", "/")
    held = {names: F.size(F.array_intersect(squeezed, F.array(*map(F.lit, names)))) for names in (REPORT_COLUMNS, WEIGHT_COLUMNS, FEATURE_COLUMNS)}

    def named(*words: str) -> Column:
        return F.arrays_overlap(F.split(place, "[/_.-]"), F.array(*map(F.lit, words)))

    cases = {
        ("model_evaluation_report", "High"): F.contains(place, F.lit("classification_report")) | (rows <= REPORT_ROWS) & (held[REPORT_COLUMNS] >= 3),
        ("feature_importance_result", "High"): F.contains(place, F.lit("feature_importance")) | (held[WEIGHT_COLUMNS] >= 1) & (held[FEATURE_COLUMNS] >= 1),
        **{(split, "High"): named(*words) for split, words in SPLIT_WORDS.items()},
        ("feature_engineering_result", "Medium"): derived,
        ("raw", "Medium"): named("raw"),
        ("unassociated", "Low"): F.lit(True),
    }
    answers = (F.when(case, F.struct(F.lit(role).alias("role"), F.lit(sure).alias("confidence"))) for (role, sure), case in cases.items())
    return reduce(F.coalesce, answers)
