"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each whole text is searched for candidates: the base kinds ``assign`` (a keyword, ``:`` or
``=``, and a value of 6 characters or more), ``access`` (AKIA..., 20 or more) and ``hex``
(24 or more), and vendor kinds (tokens with fixed prefixes, private keys). Candidates are
leftmost and non-overlapping within a kind. Positions are code points; an end is exclusive.

A private key is its header, body and END line, or where the END line is missing the header
and the base64 lines after it. Its value is the body without header fields, white space
(written as escapes too) and quotes, so that a key is the same however it is wrapped; a
header without a body is its own value.

A candidate's value is hashed. Hashes are counted over the whole corpus by distinct
repository and owner: a value at ``copied_owners`` owners or more is a widely copied example;
one that a single owner has and that looks live (``live_chars`` characters or more, letters
and digits, at least ``live_kinds`` different characters, no placeholder word; a private key:
base64 of ``live_key_chars`` characters or more, twice as many different ones) is an
owner-specific credential; the rest is unclear. Counting is pre-aggregated by (hash, owner,
repository), so a value in a third of all documents shuffles as a few rows for each task.

Rules: a null text counts as empty; null owners or repositories are one owner or repository
``<none>``. Each input row has one output row, whatever its id; repeated rows count for the
same repository once. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking

#: Fixed patterns of the base kinds; assign's second group is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A private key's header; a body up to an END line (no five dashes); base64 lines without one.
HEADER = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
BLANK = r"""(?:[\s"']|\\[nrt])"""
BODY = r"[^-]*+(?:-{1,4}+[^-]++)*+"
FIELDS = rf"(?:{BLANK}*+[A-Za-z][A-Za-z-]{{1,40}}: [^\n\\]*+)*+"
RUN = rf"{FIELDS}(?:{BLANK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{BLANK}*+[A-Za-z0-9+/]+={{1,2}})?+"
#: Fixed patterns of vendor kinds.
VENDORS = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private-key": rf"{HEADER}(?:{BODY}{HEADER.replace('BEGIN', 'END')}|{RUN})",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
}
PLACEHOLDERS = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|test|0000|1234"
SPAN = "array<struct<start:bigint,rank:int,kind:string,finish:bigint,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running_totals(numbers: Column, block: int = 256) -> Column:
    """For each number of an array of longs the sum up to it. Sums of whole blocks are added
    up first, so that a number costs a block at most and not all numbers before it."""
    def of(n: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(n) - 1) / block).cast("int"), F.lit(0)))
        sums = F.transform(blocks, lambda b: _total(F.slice(n, b * block + 1, F.lit(block))))
        before = _let(sums, lambda all_: F.transform(blocks, lambda b: _total(F.slice(all_, F.lit(1), b))))
        return _let(before, lambda start: F.transform(n, lambda _, i: F.get(start, F.floor(i / block).cast("int")) + _total(
            F.slice(n, i - i % block + 1, i % block + 1))))
    return F.when(F.size(numbers) == 0, numbers).otherwise(_let(numbers, of))


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int = 0, least: int = 1) -> Column:
    """The kind's spans: pieces between matches and the matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    matches = F.zip_with(found, values, lambda w, v: F.struct(F.length(w).cast("long").alias("size"), v.alias("value")))
    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), matches, lambda p, m: F.struct(
        (F.length(p) + m["size"]).alias("step"), m["size"].alias("size"), m["value"].alias("value")))

    def placed(ones: Column) -> Column:
        return _let(running_totals(F.transform(ones, lambda x: x["step"])), lambda ends: F.transform(
            ones, lambda x, i: F.struct(
                (F.get(ends, i) - x["size"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                F.get(ends, i).alias("finish"), x["value"].alias("value"))))

    spans = _let(zipped, placed)
    if kind == "private-key":
        spans = F.transform(spans, lambda x: x.withField("value", key_body(x["value"])))
    if least > 1:
        spans = F.filter(spans, lambda x: F.length(x["value"]) >= least)
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, text_col: str = "text") -> Column:
    """All spans of the text, by start and then kind (base kinds first)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = [_spans(text, "assign", 0, ASSIGN, 2, 6), _spans(text, "access", 1, ACCESS), _spans(text, "hex", 2, HEX)]
    # vendor tokens are rare: one test for all of them first
    some = F.regexp_like(text, F.lit("|".join(VENDORS.values())))
    vendor = F.concat(*(_spans(text, kind, 3 + i, p) for i, (kind, p) in enumerate(VENDORS.items())))
    kinds.append(F.when(some, vendor).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*kinds))


def key_body(key: Column) -> Column:
    """A private key's value."""
    inner = F.regexp_replace(key, rf"^{HEADER}{FIELDS}|{HEADER.replace('BEGIN', 'END')}$", "")
    body = F.regexp_replace(inner, BLANK, "")
    return F.when(body == "", key).otherwise(body)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["finish"])), ",")


def looks_live(kind: Column, value: Column, live_chars: int, live_kinds: int, live_key_chars: int) -> Column:
    kinds = F.size(F.array_distinct(F.split(value, "")))
    key = (F.length(value) >= live_key_chars) & value.rlike("^[A-Za-z0-9+/]+={0,2}$") & (kinds >= 2 * live_kinds)
    return F.when(kind == "private-key", key).otherwise((F.length(value) >= live_chars) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") \
        & ~value.rlike(PLACEHOLDERS) & (kinds >= live_kinds))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
         repository: Column | None = None, copied_owners: int = 3, live_chars: int = 16,
         live_kinds: int = 8, live_key_chars: int = 64) -> DataFrame:
    """id_col, spans (array of start, rank, kind, finish, value and verdict) for each row;
    verdict is copied, owner-specific or unclear. ``owner`` and ``repository`` default to the
    column source, and to source and lang together."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("<none>")), F.coalesce("lang", F.lit("<none>"))) \
        if repository is None else repository
    named = lambda c: F.coalesce(c.cast("string"), F.lit("<none>"))
    rows = linking.landed(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), named(owner).alias("owner"),
        named(repository).alias("repository"), candidates(docs, text_col).alias("spans")), "spans")
    found = rows.select("row", "owner", "repository", F.posexplode("spans").alias("pos", "span")) \
        .withColumn("hash", F.sha2("span.value", 256))
    # stored, so that the join below can split the rows of a value that stands everywhere
    spread = linking.landed(found.select("hash", "owner", "repository").distinct().groupBy("hash").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories")), "spread")
    live = looks_live(F.col("span.kind"), F.col("span.value"), live_chars, live_kinds, live_key_chars)
    verdict = F.when(F.col("owners") >= copied_owners, "copied") \
        .when((F.col("owners") == 1) & live, "owner-specific").otherwise("unclear")
    judged = found.join(spread, "hash").select(
        "row", F.struct("pos", "span.*", verdict.alias("verdict"), "owners", "repositories").alias("one")) \
        .groupBy("row").agg(F.array_sort(F.collect_list("one")).alias("judged"))
    return rows.select("row", "id").join(judged, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("judged", F.array().cast(judged.schema["judged"].dataType)).alias("spans"))


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``scan``'s rows."""
    of = lambda name, value: F.size(F.filter("spans", lambda x: x[name] == value)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < 3)
    return scanned.select(
        id_col, of("kind", "assign").alias("n_assign"), of("kind", "access").alias("n_access"),
        of("kind", "hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), of("verdict", "copied").alias("n_copied"),
        of("verdict", "owner-specific").alias("n_owner_specific"),
        F.array_max(F.transform("spans", lambda x: x["owners"])).alias("most_owners"),
        F.array_max(F.transform("spans", lambda x: x["repositories"])).alias("most_repositories"))
