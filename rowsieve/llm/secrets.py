"""Secret scans with corpus-wide ownership frequency.

Candidates are matches of a few patterns: assignments to secret names, access keys, long hex runs (the base kinds), and long
tokens, prefixed tokens and private key headers (the further kinds). The hash of each candidate's value is counted over the corpus: in
how many repositories and by how many owners it occurs. A value of more than ``max_owners`` owners or
``max_repos`` repositories is a widely copied example; one that few own and that looks random is a live credential.

Base spans always stay and carry the verdict; a candidate of a further kind becomes a span only if its value is
live and it overlaps no span before it. DataFrame functions only. Java's split and the list of matches interlock, so their lengths
give the offsets. Frequencies are summed by hash and owner before the hash alone, and meet the candidates by a
size-checked lookup, so one value in a third of all documents stays spread; texts are not shuffled.

Nulls and edge cases: null and empty texts have no span; a null owner or repository counts as one of its own; rows of one
doc_id stay rows of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm._common import by_place, lookup, materialize, read_table

#: The base kinds in order, each with its pattern and the group that holds the value.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2),
    ("access", r"AKIA[A-Z0-9]+", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
)
#: Shortest value of a base kind.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Further kinds: prefixed tokens, private key headers, and long mixed tokens.
FURTHER = (
    ("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,})", 0),
    ("key_block", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----\s*[A-Za-z0-9+/=\s]{40,}", 0),
    ("mixed", r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z_]*[0-9])(?=[a-z0-9_]*[A-Z])(?=[A-Z0-9_]*[a-z])[A-Za-z0-9_]{24,}(?![A-Za-z0-9+/_=.-])", 0),
)
KINDS = [k for k, _, _ in (*BASE, *FURTHER)]
#: Values that no live credential has.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234567|abcdef|deadbeef|0000000|test"


@dataclass(frozen=True)
class SecretConfig:
    max_owners: int = 2
    max_repos: int = 20
    #: Fewest distinct characters of a value that looks random.
    distinct_chars: int = 8


#: Elements of an array that are folded at once.
_CHUNK = 256


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, not at each place where f uses it."""
    return F.transform(F.array(x), f)[0]


def _chunks(xs: Column) -> Column:
    """xs, which should be a column or a variable, in pieces."""
    whole = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int"))
    return F.when(F.size(xs) > 0, F.transform(whole, lambda c: F.slice(xs, c * _CHUNK + 1, F.lit(_CHUNK))))


def _folded(xs: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(state, x) -> (new state, output) puts out for each element in turn, outputs being of the DDL type kind. In
    chunks, as appending to an array copies it."""
    none = lambda t: F.array().cast(f"array<{t}>")

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["at"], x)
        return F.struct(F.concat(acc["out"], F.array(out)).alias("out"), after.alias("at"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(none(kind).alias("out"), acc["at"].alias("at")), one)
        return _with(done, lambda d: F.struct(F.concat(acc["out"], F.array(d["out"])).alias("out"), d["at"].alias("at")))

    zero = F.struct(none(f"array<{kind}>").alias("out"), state.alias("at"))
    return F.coalesce(_with(xs, lambda v: F.flatten(F.aggregate(_chunks(v), zero, chunk)["out"])), none(kind))


def _running(values: Column) -> Column:
    """Sums of all values before each one."""
    return _folded(values, F.lit(0).cast("bigint"), lambda at, x: (at + x, at), "bigint")


def _found(df: DataFrame, kind: str, pattern: str, group: int) -> DataFrame:
    """Add the column kind: array of (kind, start, end, value) of every match in __text."""
    # A column of its own: used several times, it is computed once.
    df, hit = df.withColumn("__hit", F.col("__text").rlike(pattern)), F.col("__hit")
    df = df.withColumn("__all", F.when(hit, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("__gaps", F.when(hit, F.split("__text", pattern, -1)))
    df = df.withColumn("__values", F.when(hit, F.regexp_extract_all("__text", F.lit(pattern), F.lit(group)))) if group else df.withColumn("__values", F.col("__all"))
    # What lies before match i: gaps 0 to i and matches 0 to i - 1.
    df = df.withColumn("__steps", F.zip_with(F.slice("__gaps", F.lit(1), F.size("__all")), "__all", lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
    df = df.withColumn("__before", F.when(hit, _running(F.col("__steps"))))
    spans = F.transform(
        F.arrays_zip("__before", "__gaps", "__all", "__values"),
        lambda x: F.struct(F.lit(kind).alias("kind"), (x["__before"] + F.length(x["__gaps"])).alias("start"), (x["__before"] + F.length(x["__gaps"]) + F.length(x["__all"])).alias("end"), x["__values"].alias("value")),
    )
    spans = F.filter(F.slice(spans, F.lit(1), F.size("__all")), lambda x: F.length(x["value"]) >= LEAST.get(kind, 0))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return df.withColumn(kind, F.coalesce(spans, none)).drop("__hit", "__all", "__gaps", "__values", "__steps", "__before")


def candidates(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns in keep, base and further: arrays of (kind, start, end, value), start and end in code points."""
    df = docs.select(*keep, F.col(text).alias("__text"))
    for kind, pattern, group in (*BASE, *FURTHER):
        df = _found(df, kind, pattern, group)
    return df.select(*keep, F.concat(*[k for k, _, _ in BASE]).alias("base"), F.concat(*[k for k, _, _ in FURTHER]).alias("further"))


def _order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["live"].alias("live"), x["value"].alias("value")))
    return F.array_sort(keyed)


def ownership(found: DataFrame, owner: str, repo: str) -> DataFrame:
    """Per value hash: owners and repos that have it. Two levels of sums each, so no set is ever gathered."""
    rows = found.select(F.col(owner).alias("owner"), F.col(repo).alias("repo"), F.explode(F.concat("base", "further")).alias("x"))
    rows = rows.select(F.xxhash64("x.value").alias("hash"), "owner", "repo")
    pairs = materialize(rows.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")), "secret-pairs")
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("times"))
    repos = pairs.groupBy("hash", "repo").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("repos"))
    return owners.join(repos, "hash")


def scan(docs: DataFrame, cfg: SecretConfig = SecretConfig(), text: str = "text", key: str = "doc_id", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """doc_id, text_hash and spans: array of (start, rank, end, kind, live, value), base kinds and live further ones."""
    found = docs.select(F.col(key).alias("doc_id"), F.col(owner).alias("__owner"), F.col(repo).alias("__repo"), F.col(text).alias("__t"), F.xxhash64(text).alias("text_hash"))
    found = materialize(candidates(found, ("doc_id", "__owner", "__repo", "text_hash"), "__t"), "secret-candidates")
    hit = found.where((F.size("base") > 0) | (F.size("further") > 0)).withColumn("row", F.monotonically_increasing_id())
    hit = materialize(hit, "secret-hits")
    known = materialize(ownership(hit, "__owner", "__repo"), "secret-owners")
    one = hit.select("row", "doc_id", F.posexplode(F.concat("base", "further")).alias("at", "x")).withColumn("hash", F.xxhash64("x.value"))
    one = lookup(one, known, ["hash"], F.col("row"))
    random = (F.size(F.array_distinct(F.split("x.value", ""))) >= cfg.distinct_chars) & ~F.col("x.value").rlike(PLACEHOLDER)
    live = (F.col("owners") <= cfg.max_owners) & (F.col("repos") <= cfg.max_repos) & random
    base = F.col("x.kind").isin([k for k, _, _ in BASE])
    spans = one.withColumn("live", live).where(base | F.col("live"))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct(F.col("x.kind").alias("kind"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.value").alias("value"), "live")).alias("spans"))
    spans = hit.select("row", "doc_id", "text_hash").join(spans, "row", "left").select("doc_id", "text_hash", _without_overlaps(F.col("spans")).alias("spans"))
    none = found.where((F.size("base") == 0) & (F.size("further") == 0)).select("doc_id", "text_hash")
    return spans.unionByName(none, allowMissingColumns=True)


_SPAN = "struct<start:bigint,rank:bigint,end:bigint,kind:string,live:boolean,value:string>"


def _without_overlaps(spans: Column) -> Column:
    """Base spans, and those further ones that overlap no base span and no further one of an earlier kind or place. Two
    passes: one back, for the next base span behind each, one on, with the end of what is kept."""
    is_base = lambda x: x["rank"] <= len(BASE)
    far = F.lit(2**62)

    def back(at: Column, x: Column) -> tuple[Column, Column]:
        return F.when(is_base(x), x["start"]).otherwise(at), F.struct(x.alias("x"), at.alias("next"))

    def on(at: Column, y: Column) -> tuple[Column, Column]:
        x = y["x"]
        kept = is_base(x) | ((x["start"] >= at) & (x["end"] <= y["next"]))
        return F.when(kept, F.greatest(at, x["end"])).otherwise(at), F.when(kept, x)

    seen = F.reverse(_folded(F.reverse(_order(spans)), far, back, f"struct<x:{_SPAN},next:bigint>"))
    return F.filter(_folded(seen, F.lit(0).cast("bigint"), on, _SPAN), lambda x: x.isNotNull())


def joined(spans: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each of spans, in order of start, replaced by mark. Overlapping spans are one."""

    def gap(at: Column, x: Column) -> tuple[Column, Column]:
        here = F.when(x["start"] >= at, F.struct(at.alias("at"), x["start"].alias("to"), x["end"].alias("end")))
        return F.greatest(at, x["end"]), here

    gaps = F.filter(_folded(spans, F.lit(0).cast("bigint"), gap, "struct<at:bigint,to:bigint,end:bigint>"), lambda x: x.isNotNull())
    cut = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

    def pieces(part: Column) -> Column:
        # A piece of the text for each chunk, as the places of code points are counted from the start.
        whole = cut(text, part[0]["at"], F.element_at(part, -1)["to"])
        return _with(whole, lambda t: F.array_join(F.transform(part, lambda x: F.concat(cut(t, x["at"] - part[0]["at"], x["to"] - part[0]["at"]), F.lit(mark))), ""))

    end = F.array_max(F.transform(spans, lambda x: x["end"]))
    return F.concat(_with(gaps, lambda v: F.array_join(F.transform(_chunks(v), pieces), "")), F.substr(text, (end + 1).cast("int")))


def redact(docs: DataFrame, cfg: SecretConfig = SecretConfig(), text: str = "text", key: str = "doc_id", owner: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mark. Overlapping spans are one; other columns, whatever their names, are untouched."""
    rows, names = by_place(docs)
    text, key, owner = names[text], names[key], names[owner]
    found = scan(rows, cfg, text, key, owner, key).where("spans is not null").dropDuplicates(["doc_id", "text_hash"])
    found = materialize(found, "secret-spans")
    rows = rows.withColumn("text_hash", F.xxhash64(text))
    rows = rows.join(found, rows[key].eqNullSafe(found["doc_id"]) & (rows["text_hash"] == found["text_hash"]), "left")
    clean = F.when(F.size("spans") > 0, _masked(F.col(text), F.col("spans"), mark)).otherwise(F.col(text))
    return rows.withColumn(text, clean).select(*[F.col(n).alias(c) for c, n in names.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] <= len(BASE))
    count = lambda kind: F.coalesce(F.size(F.filter("spans", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    counts = [F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k, _, _ in BASE]
    live = F.coalesce(F.size(F.filter("spans", lambda x: x["live"])), F.lit(0))
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.when(F.col("spans").isNull(), 0).otherwise(live).alias("n_live"))
