"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Every text is scanned for candidate secrets. The value of each candidate is
hashed, and for each hash the distinct owners and repositories that hold it
are counted over the whole corpus: a value that many owners hold is a copied
example, and so is one that an owner has in very many repositories, as a
template has; what few owners hold in few repositories looks like a live
credential.

Base kinds are always reported. Wider kinds, which alone would give too many
false alarms, are reported only where their ownership says that they are live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Kinds in the order in which equal starts are listed, a pattern
#: (Java regular expression), the group that holds the value, its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds that ownership has to confirm. A match begins where a run
#: of its first class does and takes runs whole, so that a scan stays linear.
WIDER = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 64),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 40),
    ("prefixed", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]+", 0, 20),
    ("url", r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\s:/@]++:[^\s:/@]++@", 0, 10),
)
#: A value that more distinct owners than this hold is an example.
OWNERS = 2
#: A value that more distinct repositories of one owner hold is a template.
REPOSITORIES = 16
_BLOCK = 64
#: A quick test that any text with a candidate passes.
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|-----BEGIN |eyJ|gh[pousr]_|glpat-|xox[abprs]-|[sr]k_live_|AIza|://"


def _folded(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """(at, out) of a walk over ``items`` from at = 0: each step gives the next place and an array, of type ``kind``, of what it adds.

    Arrays grow by copying, so items are walked in blocks and the blocks joined
    at the end: the work is linear in all but arrays of very many blocks.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        at, added = step(acc["at"], item)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], added).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), empty.alias("out"))
        return F.aggregate(part, start, one, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

    def walk(items: Column) -> Column:
        last = F.greatest(F.size(items) - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(last / _BLOCK).cast("int")), lambda k: F.slice(items, k * _BLOCK + 1, F.lit(_BLOCK)))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, begin, block, lambda x: F.struct(x["at"].alias("at"), F.flatten(x["out"]).alias("out")))

    return F.transform(F.array(items), walk)[0]  # binds items, which are thus made once and not for every block


def _found(text: Column, kind: tuple[str, str, int, int]) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches of a kind, failing ones dropped.

    What stands between matches is split off, so positions are sums of lengths.
    """
    name, pattern, group, least = kind
    rule = F.lit(pattern)
    whole = F.regexp_extract_all(text, rule, F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, rule, F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    pairs = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(between, 1, F.size(whole)).alias("gap"))
    of = "struct<start:int,end:int,value:string>"
    none = F.array().cast(f"array<{of}>")

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        s = at + p["gap"]
        e = s + F.char_length(p["m"])
        hit = F.struct(s.alias("start"), e.alias("end"), p["v"].alias("value"))
        return e, F.when(F.char_length(p["v"]) >= least, F.array(hit)).otherwise(none)

    return F.when(text.rlike(pattern), _folded(pairs, of, step)["out"]).otherwise(none)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row and ``spans``: (start, rank, kind, end, hash) of every candidate, sorted.

    Positions are code points, ends exclusive; hash is SHA-256 of the value.
    A null text is an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,hash:string>>")

    def named(n: int, kind: tuple[str, str, int, int]) -> Column:
        def make(s: Column) -> Column:
            return F.struct(s["start"].alias("start"), F.lit(n).alias("rank"), F.lit(kind[0]).alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"))

        return F.transform(_found(F.col("_t"), kind), make)

    parts = [named(n, kind) for n, kind in enumerate((*BASE, *WIDER))]
    spans = F.when(F.col("_t").rlike(_ANY), F.array_sort(F.concat(*parts))).otherwise(none)
    return docs.select(*keep, text.alias("_t")).select(*keep, spans.alias("spans"))


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """hash, n_owners, n_repositories over the whole corpus.

    found: ``owner``, ``repository`` and spans. Null owners count as one owner,
    null repositories as one repository of their owner. Counting is partial
    first, so a value with a large share of the rows is a row a task after it.
    """
    held = found.select(F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.col(repository).cast("string").alias("_repository"), F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash"))
    each = held.groupBy("hash", "_owner", F.coalesce("_repository", F.lit("")).alias("_repository")).agg(F.lit(1).alias("_n"))
    owned = each.groupBy("hash", "_owner").agg(F.count("*").alias("_n"))
    return owned.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("_n").alias("n_repositories"))


def _is_base(s: Column) -> Column:
    return s["rank"] < len(BASE)


def scan(docs: DataFrame, key: str = "doc_id", owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """``key`` and ``spans`` of every row of ``docs``: base spans and confirmed wider ones.

    Each span has kind, start, end, hash and live: at most ``owners`` owners
    hold the value, in at most ``repositories`` repositories each, on average.
    Rows that repeat a key are scanned on their own. Without a column ``owner``
    all rows have one owner. No candidates gives an empty list; an empty table
    gives no rows.
    """
    own = F.col(owner) if owner in docs.columns else F.lit(None).cast("string")
    wanted = docs.select(F.col(key).alias("_key"), own.alias("_own"), F.col(repository).alias("_repo"), "text")
    found = candidates(wanted, ("_key", "_own", "_repo")).withColumn("_row", F.when(F.size("spans") > 0, F.uuid()))
    found = saved(found, "candidates")
    some = found.filter("_row IS NOT NULL")
    freq = saved(ownership(some, "_own", "_repo"), "ownership")
    lists = some.select("_row", F.explode(F.array_distinct(F.col("spans.hash"))).alias("hash")).join(freq, "hash")
    live = lists.filter((F.col("n_owners") <= owners) & (F.col("n_repositories") <= F.col("n_owners") * repositories)).groupBy("_row").agg(F.collect_set("hash").alias("_live"))
    joined = some.join(live, "_row", "left")
    none = F.array().cast("array<string>")
    marked = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"), F.array_contains(F.coalesce("_live", none), s["hash"]).alias("live")))
    with_any = joined.select(F.col("_key").alias(key), F.filter(marked, lambda s: _is_base(s) | s["live"]).alias("spans"))
    without = found.filter("_row IS NULL").select(F.col("_key").alias(key), F.array().cast(with_any.schema["spans"].dataType).alias("spans"))
    return with_any.unionByName(without)


def redact(docs: DataFrame, owner: str = "source", owners: int = OWNERS, mark: str = "<{}>") -> DataFrame:
    """``docs`` with the spans of ``scan`` replaced by their kind in angle brackets.

    Columns stay as they are; n_chars, where there is one, is counted again.
    Overlapping spans become one mark, of the first. Only texts with candidates
    are moved; the others are read where they lie. Rows that repeat a doc_id
    are matched by their text too.
    """
    text = F.coalesce("text", F.lit(""))
    may = text.rlike(_ANY)
    ident = F.xxhash64(F.col("text"), F.col("doc_id"))
    row = F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(docs.columns)))  # no name of ``docs`` meets one of ours
    keyed = docs.filter(may).select(F.struct("doc_id", ident.alias("h")).alias("id"), F.col("doc_id").alias("repository"), (F.col(owner) if owner in docs.columns else F.lit(None).cast("string")).alias("owner"), "text", row.alias("row"))
    spans = scan(keyed.select("id", "repository", "owner", "text"), "id", "owner", "repository", owners)
    spans = spans.filter(F.size("spans") > 0).groupBy("id").agg(F.first("spans").alias("spans"))
    joined = keyed.join(spans, "id", "left")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.substr(F.col("text"), at + 1, F.greatest(s["start"] - at, F.lit(0)))
        mark_of = F.concat(F.lit(mark.split("{}")[0]), s["kind"], F.lit(mark.split("{}")[1]))
        return F.greatest(at, s["end"]), F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(F.array(gap, mark_of))

    joined = joined.withColumn("_new", F.when(F.col("spans").isNotNull(), _folded(F.col("spans"), "string", step)))
    new = F.concat(F.array_join("_new.out", ""), F.substr(F.col("text"), F.col("_new.at") + 1))
    changed = joined.select("row", F.col("spans").isNotNull().alias("hit"), F.when(F.col("spans").isNotNull(), new).otherwise(F.col("text")).alias("text"))
    columns = {n: F.col(f"row.c{i}") for i, n in enumerate(docs.columns)} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("hit"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return docs.filter(~may).unionByName(changed.select(*(columns[n].alias(n) for n in docs.columns)))


def op8(documents: DataFrame) -> DataFrame:
    """Counts and spans of the secrets in every whole text of ``documents``; its source is the owner, each doc_id a repository.

    A null text is an empty one. A table without a column source is one owner's.
    """
    found = scan(documents)
    base = F.filter("spans", _is_base)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
