"""Find secrets once per content and rule version, for all paths that hold the content."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlens.sources.storage import path_exists, regrouped, shared_folder


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# A run of 20 (24) characters is the same match as a longer search for any run that drops
# the short ones: a shorter run cannot hide a longer one.
RULES = (
    Rule("assign", "(" + NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)


def content_id(text: Column) -> Column:
    """Address of a text by its content; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _label(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def unseen_contents(versions: DataFrame, rules: Sequence[Rule], scanned: DataFrame | None
                    ) -> DataFrame:
    """``blob_id, text, due``: each content once, with the rules that have not seen it.

    Equal contents are reduced to one before they meet the ledger.
    """
    due = F.array(*[F.lit(_label(r)) for r in rules])
    contents = versions.select("blob_id", "text").dropDuplicates(["blob_id"])
    if scanned is None:
        return contents.withColumn("due", due)
    seen = scanned.where(F.col("rule").isin([_label(r) for r in rules])) \
        .groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))
    return contents.join(seen, "blob_id", "left") \
        .withColumn("due", F.when(F.col("seen").isNull(), due)
                    .otherwise(F.array_except(due, F.col("seen")))) \
        .where(F.size("due") > 0).drop("seen")


def find(contents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob_id, rule, kind, start, end`` of all secrets; code points, end exclusive.

    The text between matches and the matches themselves give the places: a running sum of
    their lengths, over short rows of one content.
    """
    text = F.col("text")

    def found(rule: Rule) -> Column:
        pieces = F.transform(F.split(text, rule.pattern, -1), lambda piece: F.length(piece))
        hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        sizes = F.transform(hits, lambda hit: F.struct(
            F.length(hit).alias("length"),
            (F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least)
            .alias("kept")))
        return F.when(F.array_contains("due", _label(rule)) & text.rlike(rule.pattern),
                      F.struct(F.lit(_label(rule)).alias("rule"), F.lit(rule.kind).alias("kind"),
                               F.arrays_zip(pieces.alias("gap"), sizes.alias("hit"))
                               .alias("parts")))

    lists = contents.select("blob_id", F.explode(F.array_compact(
        F.array(*[found(r) for r in rules]))).alias("f"))
    parts = lists.select("blob_id", "f.rule", "f.kind", F.posexplode("f.parts").alias("i", "p")) \
        .where("p.hit is not null") \
        .select("blob_id", "rule", "kind", "i", F.col("p.gap").alias("gap"),
                F.col("p.hit.length").alias("length"), F.col("p.hit.kept").alias("kept"))
    upto = Window.partitionBy("blob_id", "rule").orderBy("i") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    return parts.withColumn("end", end.cast("long")).where("kept").select(
        "blob_id", "rule", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


@dataclass(frozen=True)
class Ledger:
    """Scanned pairs of content and rule, and their findings, in a shared folder."""

    spark: SparkSession
    folder: str

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def update(self, versions: DataFrame, rules: Sequence[Rule] = RULES) -> None:
        """Scan what is new in ``versions`` (``blob_id, text``).

        Findings are written first; a pair counts as scanned only after them.  A run that
        broke off in between is done again, and reading drops its repeated findings.
        """
        contents = unseen_contents(versions, rules, self._read("scanned"))
        find(contents, rules).write.mode("append").parquet(f"{self.folder}/findings")
        pairs = unseen_contents(versions.withColumn("text", F.lit(None).cast("string")), rules,
                                self._read("scanned")) \
            .select("blob_id", F.explode("due").alias("rule"))
        pairs.write.mode("append").parquet(f"{self.folder}/scanned")

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """Findings of the given rule versions."""
        return self._read("findings").where(F.col("rule").isin([_label(r) for r in rules])) \
            .distinct()


def new_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}")


def secrets_by_path(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, *,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Update the ledger and give every path its findings.

    ``doc_id, blob_id, spans`` with ``spans`` an array of (start, place, end, kind) by
    start, then by place of the kind in the list of rules.  Paths with equal texts share
    one scan.  A null text is the empty text and has no findings; repeated rows are kept;
    an empty table gives an empty result; other columns are ignored.
    """
    paths = docs.select(F.col(id_column).alias("doc_id"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text")) \
        .withColumn("blob_id", content_id(F.col("text")))
    ledger.update(paths.select("blob_id", "text"), rules)
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    per_blob = ledger.findings(rules).groupBy("blob_id").agg(F.sort_array(F.collect_list(
        F.struct("start", place[F.col("kind")].alias("place"), "end", "kind"))).alias("spans"))
    # Shuffled anew, so that Spark can split a content that very many paths hold.
    return paths.select("doc_id", "blob_id") \
        .join(regrouped(per_blob, "blob_id"), "blob_id", "left") \
        .select("doc_id", "blob_id", F.coalesce("spans", F.array()).alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
