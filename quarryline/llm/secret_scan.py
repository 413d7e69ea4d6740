"""Secret scans by corpus-wide ownership of candidate values.

Three fixed patterns give the base spans.  A wider pattern gives further candidates.  Every
candidate's hash is counted over the whole corpus by distinct repositories and distinct owners:
what many owners hold is a copied example, what a single owner holds in few repositories and looks
random is taken for a live credential, and its span is added.  Only hashes of values are written or
shuffled.  All of it is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import left_join_set, materialise

#: The base patterns, in the order in which kinds are listed.  The lengths are those
#: of group 2 (assign) and of the whole match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "owned")
ASSIGN_LEAST = 6
#: The wider pattern: long runs of the characters that keys are written in.
WIDE = r"[A-Za-z0-9+/_=-]{20,}"
#: Owners from which a value is a widely copied example.
EXAMPLE_OWNERS = 3
#: Repositories from which a value of a single owner is a copied one, and no live credential.
COPIED_REPOSITORIES = 3
#: Different characters that a live-looking value has at least.
LIVE_CHARACTERS = 10


#: Matches whose places are summed up one by one; the sums go on from run to run of so many.
RUN = 256


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the pattern's leftmost non-overlapping matches,
    in code points.  Matches whose value is shorter than ``least`` are dropped, but still consume
    their text.  A match starts behind the gaps and matches before it."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = whole if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        value,
        lambda p, v: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), v.alias("value")),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + p["size"]).alias("end"), p["value"].alias("value"))
        return F.struct((start + p["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # appending copies what is there, so places are summed up in short runs, and then the runs
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda r: F.slice(parts, r * RUN + 1, RUN))
    summed = F.transform(runs, lambda r: F.aggregate(r, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    begins = F.aggregate(summed, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
    placed = F.zip_with(
        summed,
        F.slice(begins, 1, F.size(summed)),
        lambda r, at: F.transform(r["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value"))),
    )
    found = F.flatten(placed)
    found = F.filter(found, lambda s: F.length(s["value"]) >= least) if least else found
    return F.when(F.size(whole) > 0, found).otherwise(none)


def _hashed(spans: Column) -> Column:
    """The spans with a hash of the value, and whether it looks random, in place of the value."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.sha2(s["value"].cast("binary"), 256).alias("h"),
            (s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= LIVE_CHARACTERS)).alias("random"),
        ),
    )


def _spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_example) for every row.

    ``spans`` lists kind:start:end in code points, end exclusive, by start and then by kind; the
    digest is of the base spans alone.  ``n_owned`` counts the spans that ownership adds,
    ``n_example`` the candidates that at least EXAMPLE_OWNERS owners hold.

    Null and empty texts have no spans; a text may hold any number of matches.  Null repositories and owners aren't counted, so a value
    held by null owners only counts as one owner's.  A null id stays null; repeated rows are
    reported one by one; further columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(spans_of(text, ASSIGN, 0, 2, ASSIGN_LEAST), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2))
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"),
        _hashed(base).alias("base"),
        _hashed(spans_of(text, WIDE, 3)).alias("wide"),
    )
    free = F.filter("wide", lambda w: w["random"] & ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    found = materialise(found.withColumn("wide", free), "secrets")
    # rows that agree in all of this get the same answer
    found = found.withColumn("row", F.when(F.size("base") + F.size("wide") > 0, F.sha2(F.to_json(F.struct("doc_id", "owner", "repository", "base", "wide")), 256)))

    candidates = found.where("row is not null").select("row", "repository", "owner", F.explode(F.concat("base", "wide")).alias("c"))
    candidates = candidates.select("row", "repository", "owner", "c.*").distinct()
    # distinct pairs first: a value that a third of the corpus holds is spread over its holders
    owners = candidates.select("h", "owner").distinct().groupBy("h").agg(F.count("owner").alias("owners"))
    repositories = candidates.select("h", "repository").distinct().groupBy("h").agg(F.count("repository").alias("repositories"))
    # written, so that the join below has shuffles of its own, in which a hot value can be split
    ownership = materialise(owners.join(repositories, "h"), "ownership")
    live = (F.col("kind") == len(KINDS) - 1) & (F.col("owners") <= 1) & (F.col("repositories") < COPIED_REPOSITORIES)
    judged = (
        candidates.join(ownership, "h")
        .groupBy(F.col("row").alias("of"))
        .agg(
            F.collect_list(F.when(live, F.struct("start", "kind", "end"))).alias("owned"),
            F.count(F.when(F.col("owners") >= EXAMPLE_OWNERS, 1)).alias("n_example"),
        )
    )
    places = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    owned = F.coalesce("owned", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return left_join_set(found, judged, "row", "of").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_spelled(places).cast("binary"), 256).alias("base_sha256"),
        _spelled(F.concat(places, owned)).alias("spans"),
        F.size(owned).cast("long").alias("n_owned"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )
