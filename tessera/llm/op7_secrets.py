"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for the base kinds and for provider tokens. Each found value is hashed; hashes are
aggregated over the whole corpus by distinct owner and repository. A value held by ``WIDE`` or more owners, or in
``WIDE_REPOS`` or more repositories, is a widely copied example; one with fewer that also looks random is
owner-specific and live-looking. The base spans always stay; the method adds the provider tokens that it finds
owner-specific.

One rule decides what looks random, for ``secrets`` and for what ``redacted`` masks (``leaks``): any length, entropy
relative to what the length and the kind's alphabet allow; only values that are placeholders as a whole don't count.

Scale: candidates are few, so the corpus text is never shuffled; their places are running sums over the rows of
one text. The distinct counts go through three map-side combined aggregations (owner and repository, owner, value),
so a value in a third of all documents costs each task one row; on the way back such values are broadcast
(``join_hot``).

Defined results: null text counts as empty; a null owner or repository counts as one owner or repository
of its own; rows may repeat and ids may be null (rows are told apart by position, never by id); an empty
table gives an empty result; extra columns are ignored, also those named like the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_packed, join_hot

# The patterns of the kinds, the group that holds the value and its least length.
KINDS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "provider": (r"(?:gh[opsu]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 14),
}
BASE, ADDED = ("assign", "access", "hex"), ("provider",)
#: A literal without which a kind can't match: texts without it skip the pattern.
NEEDS = {"access": ("AKIA",), "provider": ("gh", "xox", "k_live_", "AIza", "eyJ")}
#: Owners from which on a value is a widely copied example.
WIDE = 5
#: Repositories from which on a value is a widely copied example, even of one owner.
WIDE_REPOS = 50
#: Characters of a text that are cut out together when spans are masked.
BLOCK = 4096
#: Characters that a random value of the kind is drawn from, and the least share of the greatest possible entropy.
ALPHABET, RANDOM_SHARE = {"assign": 64, "access": 32, "hex": 16, "provider": 64}, 0.6
#: What placeholders are put together from; a value of which nothing else is left is one as a whole.
FILLER = (
    r"example|changeme|change|dummy|sample|placeholder|password|passwd|secret|token|value|string|default|insert|replace|redacted|undefined|hidden|access|api|key|your|my|test|here|null|none|true|false|todo"
    r"|deadbeef|qwerty|0123456789abcdef|0?1234(?:5(?:6(?:7(?:8(?:90?)?)?)?)?)?|123|abcdef|abcd|(.)\1{3,}|[+/_.=-]"
)
PREFIX = r"^(?:AKIA|gh[opsu]_|xox[abprs]-|[sr]k_live_|AIza)"
#: Further placeholders as a whole: long values that repeat one part, and those with the ending reserved for documentation.
REPEATED, RESERVED, LONG = r"^(.{1,16})\1+$", r"EXAMPLE(?:KEY)?$", 20


def _pattern(kind: str) -> Column:
    return F.lit(KINDS[kind][0])


def found(text: Column, kind: str) -> Column:
    """The kind's matches as text, leftmost and non-overlapping."""
    all_ = F.regexp_extract_all(text, _pattern(kind), F.lit(0))
    none = F.array().cast("array<string>")
    need = NEEDS.get(kind)
    return all_ if not need else F.when(F.expr(" or ".join(f"contains(text, '{x}')" for x in need)), all_).otherwise(none)


def candidates(text: Column) -> Column:
    """``array<struct<rank,i,gap,match>>`` of all kinds: each match with the length of the text between it and the match before."""

    def of(kind: str) -> Column:
        matches = found(text, kind)
        gaps = F.slice(F.split(text, KINDS[kind][0], -1), F.lit(1), F.size(matches))
        both = F.transform(
            F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), matches.alias("match")),
            lambda x, i: F.struct(F.lit([*KINDS].index(kind)).alias("rank"), i.alias("i"), x["gap"].alias("gap"), x["match"].alias("match")),
        )
        return F.when(F.size(matches) > 0, both).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,match:string>>"))

    return F.concat(*[of(k) for k in KINDS])


def scan(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, ``rid`` (the row's place) and ``found``, all candidates of a row; one narrow pass in which each pattern runs once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    got = docs.select(*keep, F.monotonically_increasing_id().alias("rid"), text.alias("text"))
    return got.withColumn("found", candidates(F.col("text"))).drop("text")


def located(rows: DataFrame) -> DataFrame:
    """``rid, owner, repo, kind, rank, start, end, value`` of the candidates of ``rows(rid, owner, repo, found)`` that are long enough.

    Places are running sums over the matches of one kind and text, so the work is linear in the matches.
    """
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    each = rows.where(F.size("found") > 0).select("rid", "owner", "repo", F.explode("found").alias("f")).select("rid", "owner", "repo", "f.*").withColumn("kind", kind)
    upto = Window.partitionBy("rid", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto).cast("int")).withColumn("start", F.col("end") - F.length("match"))
    value, least = F.col("match"), F.lit(0)
    for k, (pattern, group, n) in KINDS.items():
        value = F.when(F.col("kind") == k, F.regexp_extract("match", pattern, group)).otherwise(value) if group else value
        least = F.when(F.col("kind") == k, F.lit(n)).otherwise(least)
    return each.select("rid", "owner", "repo", "kind", "rank", "start", "end", value.alias("value")).where(F.length("value") >= least)


def placeholder(value: Column) -> Column:
    """True for values that are placeholders as a whole, not for those that merely contain such a word."""
    rest = F.regexp_replace(F.lower(F.regexp_replace(value, PREFIX, "")), FILLER, "")
    return (rest == "") | ((F.length(value) >= LONG) & (value.rlike(REPEATED) | value.rlike(RESERVED)))


def leaks(value: Column, kind: Column) -> Column:
    """True for values of ``kind`` that look random for their length and are no placeholder."""
    n, alphabet = F.length(value), F.create_map(*[F.lit(x) for kv in ALPHABET.items() for x in kv])[kind]
    counts = F.transform(F.array_distinct(F.split(value, "")), lambda c: (n - F.length(F.replace(value, c, F.lit("")))).cast("double"))
    entropy = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - c / n * F.log2(c / n))
    return (F.round(entropy, 9) >= F.round(RANDOM_SHARE * F.log2(F.least(n, alphabet)), 9)) & ~placeholder(value)


def ownership(candidates: DataFrame, wide: int = WIDE, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """``(hash, n, n_owners, n_repos, copied)`` for each hash of ``candidates(hash, owner, repo)``: rows, distinct owners and repositories."""
    pairs = candidates.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    known = owners.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    return known.withColumn("copied", (F.col("n_owners") >= wide) | (F.col("n_repos") >= wide_repos))


def judged(rows: DataFrame, wide: int = WIDE, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """``(rid, kind, rank, start, end, live, copied)`` for each candidate of ``rows(rid, owner, repo, found)``."""
    each = cut_packed(located(rows).withColumn("hash", F.sha2("value", 256)))
    known = cut_packed(ownership(each, wide, wide_repos))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    said = join_hot(each, known, "hash", "n", total, "copied")
    return said.select("rid", "kind", "rank", "start", "end", "copied", (~F.col("copied") & leaks(F.col("value"), F.col("kind"))).alias("live"))


def _joined(which: Column) -> Column:
    spans = F.array_sort(F.collect_list(F.when(which, F.struct("start", "rank", "end", "kind"))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", wide: int = WIDE, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """The contract's rows and, for each document, how many of its values are live-looking or widely copied."""
    rows = cut_packed(scan(docs, F.col("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo")))
    base = F.col("kind").isin(*BASE)
    said = judged(rows, wide, wide_repos).groupBy("rid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE], _joined(base).alias("base"), _joined(base | F.col("live")).alias("spans"), F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied")
    )
    zero, none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c), lambda c: F.coalesce(c, F.lit(""))
    return rows.select("rid", "doc_id").join(said, "rid", "left").select(
        "doc_id", *[zero(f"n_{k}") for k in BASE], F.sha2(none("base"), 256).alias("base_sha256"), none("spans").alias("spans"), zero("n_live"), zero("n_copied")
    )


def _piece(start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of the text in ``blocks``, without a walk from the text's beginning."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice("blocks", first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * BLOCK + 1, end - start)).otherwise("")


def redacted(docs: DataFrame, owner: str = "source", repo: str = "doc_id", wide: int = WIDE, mask: str = "[SECRET]", wide_repos: int = WIDE_REPOS) -> DataFrame:
    """``docs`` with the owner-specific values that ``leaks`` finds random masked in ``text`` and ``n_chars`` set anew.

    The patterns run once, in a pass that is kept in the shared folder. Texts without a candidate pass untouched and are
    not shuffled. Of overlapping spans the first writes the mask and the others extend what it covers.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(c) for c in {"text", owner, repo}])
    held = cut_packed(scan(packed, F.col("row"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo")))
    live = judged(held.drop("row"), wide, wide_repos).where("live").select("rid", "start", "end")
    order = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = live.withColumn("new", (F.col("start") >= reach).cast("int")).withColumn("at", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    masks = live.groupBy("rid", "at").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("masks"))
    rest = held.where(F.size("found") > 0).select("rid", "row").join(masks, "rid", "left")
    done = rest.where("masks is not null").withColumn("blocks", F.regexp_extract_all("row.text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    before = lambda i: F.when(i > 0, F.get("masks", i - 1)["end"]).otherwise(0)
    kept = F.transform("masks", lambda m, i: F.concat(_piece(before(i), m["start"]), F.lit(mask)))
    done = done.withColumn("new", F.concat(F.array_join(kept, ""), _piece(F.element_at("masks", -1)["end"], F.length("row.text"))))
    of = lambda c: F.col(f"row.`{c}`").alias(c)
    new = {"text": F.col("new").alias("text"), "n_chars": F.length("new").cast("long").alias("n_chars")}
    same = held.where(F.size("found") == 0).select("row").unionByName(rest.where("masks is null").select("row"))
    return same.select(*[of(c) for c in docs.columns]).unionByName(done.select(*[new.get(c) if c in new else of(c) for c in docs.columns]))
