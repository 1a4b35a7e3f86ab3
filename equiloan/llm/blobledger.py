"""Secret scans over an incremental blob ledger (operator 13).

Every historical version of every path is content-addressed: its blob is the
SHA-256 of its UTF-8 bytes. The ledger is a stored table with one row per blob
and scan: the rule versions that were run on the blob and what they found. A
scan reduces the versions to their distinct blobs, takes the (blob, rule
version) pairs that the ledger does not hold, runs those rules on one copy of
each such text and appends a row. Findings are then joined back from the blob
to every path that ever held it. So a copy, a revert or a second run costs no
scan, and a new version of one rule is run alone on the blobs already known.

All of it is DataFrame expressions. The places of a pattern's matches
(leftmost, not overlapping) come from the matches and from the pieces of the
text between them: their lengths in code points, alternating, add up to the
starts. They are added in blocks, so a text with very many matches stays
cheap.

Skew: a blob that very many paths share is one row after the map-side
reduction. In the join back, blobs with more than ``total / HOT_SHARE`` paths
(at most ``HOT_SHARE`` blobs by construction) are looked up in a broadcast
table, so no task gathers one blob's paths.

Cases: a null text is the empty text; a null path keeps its row; repeated rows
and rows sharing a path are versions of their own and each returns its own
row. Very long texts are scanned whole. Ties cannot occur: one rule's matches
do not overlap, and spans at one start are ordered by kind. An empty table
gives an empty result. Columns other than the path and the text are not read,
so their names cannot clash. A scan that is run twice, or twice at once, adds
rows that say the same; the join back takes each finding once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiloan.llm.runtime import stash
from equiloan.session import shared_path

#: A hot blob has more than this fraction (1 / HOT_SHARE) of all versions.
HOT_SHARE = 10_000
#: Bytes of span lists that may be broadcast for the hot blobs.
HOT_BYTES = 32 << 20
_BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A pattern under a version. ``group`` is the part that must have
    ``least`` code points; ``needs`` is a literal every match contains."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules.
BASE = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
         r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
)
#: What this method adds: secrets that announce themselves by their form.
ADDED = (
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("forge", 1, "gh[pousr]_[A-Za-z0-9]{36,255}", needs="gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.%+-]{1,64}@", needs="://"),
)
RULES = BASE + ADDED

_SPAN = "struct<start:bigint,stop:bigint>"
_SCHEMA = "blob binary, rules array<string>, found array<struct<rule:string,start:bigint,stop:bigint>>"


def blob(text: Column | str) -> Column:
    """The content address of a text (null as the empty text)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _long_length(x: Column) -> Column:
    return F.length(x).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(text: Column, rule: Rule) -> Column:
    """array of (start, stop) in code points of the rule's matches in a text
    that has one."""
    pattern = F.lit(f"({rule.pattern})")
    taken = F.struct(F.regexp_extract_all(text, pattern, F.lit(1)).alias("body"),
                     F.regexp_extract_all(text, pattern, F.lit(rule.group + 1)).alias("held"),
                     F.split(text, rule.pattern, -1).alias("gaps"))

    def pieces(x: Column) -> Column:
        sized = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["body"])), x["body"],
                           lambda g, m: F.struct(_long_length(g).alias("gap"), _long_length(m).alias("len")))
        return F.zip_with(sized, x["held"], lambda p, h: F.struct(
            p["gap"].alias("gap"), p["len"].alias("len"), (F.length(h) >= rule.least).alias("ok")))

    return _let(taken, lambda x: _let(pieces(x), _spans))


def _spans(pieces: Column) -> Column:
    """Running places of alternating (gap, match) lengths, block by block."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / F.lit(_BLOCK)).cast("int"))
    part = lambda b: F.slice(pieces, b * F.lit(_BLOCK) + 1, F.lit(_BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(
        part(b), F.lit(0).cast("long"), lambda a, p: a + p["gap"] + p["len"]))
    starts = F.aggregate(sums, F.array(F.lit(0).cast("long")),
                         lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.array(F.struct(start.alias("start"), (start + p["len"]).alias("stop")))
        return F.struct((start + p["len"]).alias("at"),
                        F.concat(acc["out"], F.when(p["ok"], span).otherwise(empty)).alias("out"))

    def walk(b: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), empty.alias("out"))
        return F.aggregate(part(b), first, step, lambda acc: acc["out"])

    return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), walk))


def _under(name: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(name).alias("rule"), s["start"].alias("start"), s["stop"].alias("stop")))


def _of(kind: str) -> Column:
    return F.filter("found", lambda s: s["kind"] == kind)


def _found(text: Column, todo: Column, rules: Iterable[Rule]) -> Column:
    """What the rules named in ``todo`` find, as one array."""
    parts = []
    for rule in rules:
        hit = F.array_contains(todo, rule.name)
        if rule.needs:
            hit = hit & F.contains(text, F.lit(rule.needs))
        hit = hit & text.rlike(rule.pattern)
        parts.append(F.when(hit, _under(rule.name, _places(text, rule))).otherwise(
            F.array().cast("array<struct<rule:string,start:bigint,stop:bigint>>")))
    return F.concat(*parts)


class BlobLedger:
    """The ledger in a folder of the shared storage (a fresh one under the
    checkpoint folder unless named). ``record`` scans what is new in some
    versions; ``findings`` joins all that is known back to their paths."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: Iterable[Rule] = RULES):
        self.spark, self.rules = spark, tuple(rules)
        self.path = path or shared_path(spark, "blob-ledger")
        if len({r.name for r in self.rules}) < len(self.rules):
            raise ValueError("a rule version occurs twice")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def rows(self) -> DataFrame:
        """blob, rules, found: one row per blob and scan that covered it."""
        if not self._exists():
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def unseen(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """blob, body, todo: the distinct blobs with rule versions that the
        ledger does not hold for them, one copy of each text."""
        body = F.coalesce(F.col(text), F.lit(""))
        blobs = versions.select(blob(F.col(text)).alias("blob"), body.alias("body")).dropDuplicates(["blob"])
        names = F.array(*[F.lit(r.name) for r in self.rules])
        if not self._exists():
            return blobs.withColumn("todo", names)
        seen = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        return (blobs.join(seen, "blob", "left")
                .withColumn("todo", F.when(F.col("done").isNull(), names).otherwise(F.array_except(names, "done")))
                .filter(F.size("todo") > 0).drop("done"))

    def record(self, versions: DataFrame, text: str = "text") -> BlobLedger:
        """Scan the unseen (blob, rule version) pairs and append them."""
        new = self.unseen(versions, text)
        (new.select("blob", F.col("todo").alias("rules"), _found(F.col("body"), F.col("todo"), self.rules).alias("found"))
         .write.mode("append").option("compression", "zstd").parquet(self.path))
        return self

    def findings(self, versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
        """path, blob, found: every version with what the current rules found
        in its blob, (start, rank of the kind, stop, kind) in this order."""
        held = stash(versions.select(F.col(path).alias("path"), blob(F.col(text)).alias("blob")), "blob-paths")
        return self.join_back(held).withColumnRenamed("path", path)

    def join_back(self, held: DataFrame) -> DataFrame:
        """``findings`` of a stored table (path, blob)."""
        ranks = {r.name: (i, r.kind) for i, r in enumerate(self.rules)}
        span = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"
        known = self.rows().filter(F.size("found") > 0)
        all_spans = F.flatten(F.collect_list("found"))
        current = F.filter(all_spans, lambda s: s["rule"].isin(*ranks))
        rank = F.create_map(*[F.lit(x) for name, (i, _) in ranks.items() for x in (name, i)])
        kind = F.create_map(*[F.lit(x) for name, (_, k) in ranks.items() for x in (name, k)])
        placed = F.transform(current, lambda s: F.struct(
            s["start"].alias("start"), rank[s["rule"]].alias("rank"), s["stop"].alias("stop"),
            kind[s["rule"]].alias("kind")))
        spans = known.groupBy("blob").agg(F.array_sort(F.array_distinct(placed)).alias("found")) \
            .filter(F.size("found") > 0)
        total = held.count()
        paths = held.groupBy("blob").agg(F.count(F.lit(1)).alias("paths"))
        heavy = paths.filter(F.col("paths") > F.greatest(F.lit(1000), F.lit(total // HOT_SHARE))).select("blob")
        hot = stash(heavy.join(spans, "blob", "left"), "hot-blobs")
        # At most HOT_SHARE blobs; their span lists are measured.
        room = hot.agg(F.coalesce(F.sum(F.size("found") * F.lit(40)), F.lit(0))).first()[0]
        none = F.array().cast(span)
        if room > HOT_BYTES:  # extremely full texts: Spark's own split of skewed joins spreads them
            return held.join(spans, "blob", "left").select("path", "blob", F.coalesce("found", none).alias("found"))
        mark = F.broadcast(hot.select("blob", F.col("found").alias("_hot"), F.lit(True).alias("_is_hot")))
        looked = held.join(mark, "blob", "left")
        done = looked.filter("_is_hot").select("path", "blob", F.coalesce("_hot", none).alias("found"))
        rest = looked.filter("_is_hot is null").select("path", "blob").join(spans, "blob", "left")
        return rest.select("path", "blob", F.coalesce("found", none).alias("found")).unionByName(done)


def secrets(docs: DataFrame, rules: Iterable[Rule] = RULES, ledger: BlobLedger | None = None,
            path: str = "doc_id") -> DataFrame:
    """path, blob, found of all documents, through a ledger (a new one unless
    given: then only what it has not seen is scanned)."""
    ledger = ledger or BlobLedger(docs.sparkSession, rules=rules)
    return ledger.record(docs).findings(docs, path)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = [r.kind for r in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(_of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("found")).alias("spans"))
