"""Secret scans with corpus-wide ownership frequency (operator 6), in
DataFrame functions only.

Every whole text is searched for each kind of ``KINDS``; a match's position
is the running length of what stands before it.  Candidate values are hashed
and counted over the whole corpus by distinct owner and by distinct
repository of an owner.  A value that many owners or many repositories share
is a copied example; one that few have and that does not look like a filler is
taken for a live credential.

Hot values: counts combine before every shuffle, first by (value, owner,
repository); only widely copied values are joined back to the spans.

Defined results: a null text is an empty one; null owners and repositories
are each one owner or repository; rows with null or repeated doc_ids and
repeated rows are documents of their own (told apart by a row number);
extra columns are ignored by ``scan`` and kept by ``redact``; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopflow.llm.common import materialize, maybe_broadcast, read_table

# Fixed values: (kind, pattern, group of the secret, least characters of the
# secret, least characters of the match, texts one of which a lower-cased text
# holds if there is a match).  The first three are the base.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, 0,
     ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20, ("akia",)),
    ("hex", r"[0-9a-f]{24,}", 0, 0, 24, ()),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 0, ("eyj",)),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*", 0, 0, 0, ("private key-----",)),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s:@/]{1,100}:([^\s:@/]{3,100})@", 1, 0, 0, ("://",)),
]
BASE = ("assign", "access", "hex")
COPIED_OWNERS = 4          # a value of so many owners is a copied example,
COPIED_REPOSITORIES = 12   # or of so many repositories, whoever owns them
LEAST_VARIETY = 5    # distinct characters of a live-looking value


def _matches(text: Column, number: int) -> Column:
    """Array of (kind, before, length, value): ``before`` counts the characters
    between the previous match and this one."""
    _, pattern, group, least_value, least_match, hints = KINDS[number]
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(pieces.alias("p"), whole.alias("m"), value.alias("v"))
    rows = F.transform(zipped, lambda z: F.struct(
        F.lit(number).alias("kind"), F.char_length(z["p"]).alias("before"), F.char_length(z["m"]).alias("length"), z["v"].alias("value")))
    none = F.array().cast("array<struct<kind:int,before:int,length:int,value:string>>")
    some = F.filter(rows, lambda z: z["length"].isNotNull())
    if not hints:
        return F.when(text.rlike(pattern), some).otherwise(none)
    low = F.lower(text)
    hint = None
    for h in hints:
        hint = low.contains(h) if hint is None else hint | low.contains(h)
    return F.when(hint, some).otherwise(none)


def _with_rows(docs: DataFrame, text: str, owner: str, repository: str, keep: Column | None = None) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.flatten(F.array(*[_matches(body, i) for i in range(len(KINDS))]))
    columns = [F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col(owner).cast("string").alias("owner"),
               F.col(repository).cast("string").alias("repository"), found.alias("found")]
    return docs.select(*columns, *([keep.alias("kept_row")] if keep is not None else []))


def spans(rows: DataFrame) -> DataFrame:
    """(row, owner, repository, kind, start, end, value): accepted matches, code points."""
    each = rows.select("row", "owner", "repository", F.posexplode("found").alias("n", "m")).select("row", "owner", "repository", "n", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("length")).over(order)
    least_value = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    least_match = F.element_at(F.array(*[F.lit(k[4]) for k in KINDS]), F.col("kind") + 1)
    return (each.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
                .where((F.char_length("value") >= least_value) & (F.col("length") >= least_match))
                .select("row", "owner", "repository", "kind", "start", "end", "value"))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories, places): how widely each value is spread."""
    by_repository = found.groupBy(F.sha2("value", 256).alias("value_hash"), "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("places").alias("places"))
    return by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places"))


SPREAD = ("owners", "repositories", "places")


def judged(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Adds owners, repositories and places of the value, ``copied`` and ``live``.

    Values found once are not joined: their counts are one.
    """
    wide = ownership(found).where(F.col("places") > 1).select("value_hash", *SPREAD)
    variety = F.size(F.array_distinct(F.split("value", "")))
    filler = F.lower("value").rlike("example|changeme|placeholder|xxxx|0000000|1234567") | (variety < LEAST_VARIETY)
    out = found.withColumn("value_hash", F.sha2("value", 256)).join(maybe_broadcast(wide), "value_hash", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(1)) for c in SPREAD})
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    return out.withColumn("copied", copied).withColumn("live", ~F.col("copied") & ~filler)


def _join(array: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """A row per document: its spans, how many look live, how many are copied, and
    the most owners, repositories and places that one of its values has."""
    rows = materialize(_with_rows(docs, text, owner, repository), "secrets")
    found = judged(spans(rows.where(F.size("found") > 0)))
    place = F.struct("start", "kind", "end")
    is_base = F.col("kind") < len(BASE)
    per_row = found.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sort_array(F.collect_list(F.when(is_base, place))).alias("b"), F.sort_array(F.collect_list(place)).alias("s"),
        F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"), *[F.max(c).alias(c) for c in SPREAD])
    counts = [f"n_{k}" for k in BASE]
    return rows.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.sha2(F.coalesce(_join(F.col("b")), F.lit("")), 256).alias("base_sha256"), F.coalesce(_join(F.col("s")), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied", *SPREAD)])


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "lang", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking secret's span replaced by ``mask``.

    Overlapping spans are masked as one.  A column ``n_chars`` follows the text.
    """
    rows = materialize(_with_rows(docs, text, owner, repository, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), "secrets")
    live = judged(spans(rows.where(F.size("found") > 0).drop("kept_row"))).where("live")
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cuts = (live.select("row", "start", "end").withColumn("new", F.when(F.col("start") < before, 0).otherwise(1))
                .withColumn("cut", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy("row", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    # What stays between the cuts: from the end of one to the start of the next.
    kept = cuts.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0)))
    per_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "start"))).alias("kept"), F.max("end").alias("rest"))
    body = F.col(f"kept_row.`{text}`")
    masked = F.concat(F.concat_ws("", F.transform("kept", lambda k: F.concat(
        F.substring(body, k["from"] + 1, k["start"] - k["from"]), F.lit(mask)))),
        F.substring(body, F.col("rest") + 1, F.char_length(body)))
    changed = F.when(F.col("kept").isNull(), body).otherwise(masked)
    joined = rows.select("row", "kept_row").join(maybe_broadcast(per_row), "row", "left").withColumn("changed", changed)
    out = []
    for c in docs.columns:
        value = F.col(f"kept_row.`{c}`")
        if c == text:
            value = F.col("changed")
        elif c == "n_chars":
            value = F.when(F.col("kept").isNull(), value).otherwise(F.char_length("changed").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return joined.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: secrets of all documents; a source is an owner, a language of it a repository."""
    return scan(read_table(spark, sf_dir, "documents"))
