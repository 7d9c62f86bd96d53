"""Secret scans over an incremental blob ledger, with DataFrame functions alone.

Texts are content-addressed by SHA-256. The ledger, an append-only Parquet table in a shared folder, holds a row for each
(blob, scan) with the rule versions that the scan covered and what it found. A scan reads the ledger, takes only blobs for
which some rule version is new, one text for each, and runs only the new rules on them; findings are then joined back
to every path (row) whose text has that blob. Rules that the ledger knows by an older version are scanned again, and only
the current version's findings are joined back.

Defined cases: a null text counts as empty; empty texts have no findings; repeated rows each get the blob's findings; an
empty table gives an empty result and leaves the ledger as it is; columns besides id and text are ignored, whatever their names.

Texts that very many rows share are told from the counts of blobs: rows of a blob with more than a thousandth of all rows are dealt
to several tasks where findings are joined back, and empty texts take no part in that join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .shared import new_path, path_exists

SHARES = 1000
FOUND = "array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """pattern: for Java's matcher. least: the least length of the given group. has: a cheap text that any match holds, or None."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    has: str | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def find(self, text: Column) -> Column:
        found = S.spans(text, self.name, self.pattern, None if self.has is None else F.contains(text, F.lit(self.has)))
        if self.least:
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["text"], self.pattern, self.group)) >= self.least)
        return F.transform(found, lambda s: F.struct(s["kind"].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))


# The kinds in the order in which spans that start together are listed. The first three are the base kinds;
# runs too short for the last two fail as a whole, so a least count in the pattern finds the same spans.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+", has="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}+"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", has="PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+", has="eyJ"),
)
BASE = ("assign", "access", "hex")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, findings) for each row of docs, after the ledger at that path has been brought up to date.

    Only hashes and the texts of unseen blobs are shuffled; copies of a text meet in a group-by that combines map-side.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
    want = F.array(*[F.lit(r.key) for r in rules])
    unseen = versions.where("text <> ''").groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", want)
    known = path_exists(spark, ledger)
    if known:
        before = spark.read.parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"))
        todo = F.when(F.col("scanned").isNull(), want).otherwise(F.array_except(want, F.col("scanned")))
        # hashes first: texts of blobs that need nothing are not carried to the scan
        need = versions.where("text <> ''").select("blob").distinct().join(before, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)
        unseen = versions.where("text <> ''").join(need, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    found = F.concat(*[F.when(F.array_contains("todo", r.key), r.find(F.col("text"))).otherwise(F.array().cast(FOUND)) for r in rules])
    unseen.select("blob", F.col("todo").alias("scanned"), found.alias("findings")).write.mode("append").parquet(ledger)

    names = {r.name: r.key for r in rules}
    rows = spark.read.schema(f"blob binary, scanned array<string>, findings {FOUND}").parquet(ledger).where(F.size("findings") > 0)
    # a scan's findings count for the rules whose present version it covered
    current = F.create_map(*[x for name, key in names.items() for x in (F.lit(name), F.lit(key))])
    findings = rows.select("blob", F.filter("findings", lambda f: F.array_contains(F.col("scanned"), current[f["rule"]])).alias("findings"))
    findings = findings.groupBy("blob").agg(S.distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
    share = max(1, docs.count() // SHARES)
    frequent = versions.where("text <> ''").groupBy("blob").count().where(F.col("count") > share).select("blob", F.ceil(F.col("count") / share).cast("int").alias("parts"))
    # fewer than 2 * SHARES blobs can be that frequent
    slim = versions.select("id", "blob", F.when(F.col("text") != "", F.col("blob")).alias("b"), "text")
    place = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    # what joins nothing gets a key of its own
    slim = slim.join(F.broadcast(frequent.withColumnRenamed("blob", "b")), "b", "left").select("id", "blob", F.coalesce("b", F.unhex(F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"), 224))).alias("b"), place.alias("part"))
    split = findings.withColumnRenamed("blob", "b").join(F.broadcast(frequent.withColumnRenamed("blob", "b")), "b", "left")
    split = split.select("b", "findings", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return slim.join(split, ["b", "part"], "left").select(F.col("id").alias(id_col), "blob", F.coalesce("findings", F.array().cast(FOUND)).alias("findings"))


def digest(found: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, the digest of the base spans and all spans of each row of scan()."""
    kinds = [r.name for r in rules]
    f = F.col("findings")
    as_spans = F.transform(f, lambda s: F.struct(s["rule"].alias("kind"), s["start"], s["end"]))
    base = F.filter(as_spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        id_col,
        *[S.count_of(as_spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(S.in_order(base, kinds).cast("binary"), 256).alias("base_sha256"),
        S.in_order(as_spans, kinds).alias("spans"),
        F.lower(F.hex("blob")).alias("blob"),
    )


def scan_once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan() with a ledger that lives as long as this session."""
    return scan(docs, new_path(docs.sparkSession, "ledger"), RULES, id_col, text_col)


def without_secrets(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the texts that hold secrets masked: the union of all spans of a text is replaced, the rest stays.

    Texts are joined to findings by blob, so that ids may repeat. docs' columns go by number on the way, so that none clashes.
    """
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    known = docs.select(*columns, F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ledger = new_path(docs.sparkSession, "ledger")
    found = scan(known, ledger, RULES, "i", "t").where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
    joined = known.withColumn("blob", F.unhex(F.sha2(F.coalesce("t", F.lit("")).cast("binary"), 256))).join(found, "blob", "left")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        # a span that begins before the last one's end only widens it
        return F.greatest(at, s["end"]), F.struct(F.when(s["start"] >= at, at).alias("a"), s["start"].alias("b"), F.greatest(at, s["end"]).alias("end"))

    ordered = S.distinct(F.transform("findings", lambda s: F.struct(s["start"], s["end"])))
    gaps = S.running(ordered, F.lit(0), "int", "struct<a:int,b:int,end:int>", step)
    masked = S.bound(
        F.struct(S.blocks(F.col("t")).alias("blocks"), gaps.alias("gaps")),
        lambda x: F.concat(
            F.array_join(F.transform(F.filter(x["gaps"], lambda g: g["a"].isNotNull()), lambda g: F.concat(S.part(x["blocks"], g["a"], g["b"]), F.lit(mask))), ""),
            S.part(x["blocks"], F.element_at(x["gaps"], -1)["end"], F.length(F.col("t"))),
        ),
    )
    masked = F.when(F.col("findings").isNotNull(), masked).otherwise(F.col("t"))
    return joined.select(*[masked.alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
