"""Quality rules as a bitmask ledger: each rule is evaluated once, its bit and its measurements are stored with the rules' version, policies are applied
to the stored bits, and ablations are sums over masks. DataFrame functions only; nothing is shuffled but the ablations' few masks.

Words are runs of characters other than space and U+0009 to U+000D. Handling: a null or empty text has no words; null ids and further columns pass
through, whatever their names; equal rows give equal rows; an empty table gives an empty ledger; there are no ties, as each row is judged by itself; a
text is measured whole, its words and windows being arrays of its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]++"

#: name, condition under which a text fails; the place in the list is the bit.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("few_letters", "10 * n_letters < 6 * word_chars"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
)
#: Goes up with every change of RULES or of a measurement; policies are for the bits of one version.
RULES_VERSION = 2
#: Letters are ASCII ones and all characters beyond; bullets stand before a line's text; an ellipsis ends a line.
OTHERS, BULLET, ELLIPSIS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]++", r"^[\x20\x09-\x0D]*[-*+\u2022\u2023\u25aa\u25cf]", r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version's name and the rules whose failure rejects a text."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = {p.version: p for p in (
    Policy("base", BASE), Policy("v1", tuple(name for name, _ in RULES[:6])), Policy("v1-lines", tuple(name for name, _ in RULES[:6] if name != "duplicate_lines")), Policy("v2", tuple(name for name, _ in RULES)),
)}


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all, unless given) in struct `row`, and n_words, word_chars, n_symbols, n_letters, n_lines, n_dup_lines, n_bullet_lines, n_ellipsis_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    step = docs.select(
        row,
        F.array_remove(F.split(t, SPACE), "").alias("words"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, OTHERS, "")).cast("long").alias("n_letters"),
    )
    step = step.select(
        "row",
        "n_symbols",
        "n_letters",
        F.size(F.filter("lines", lambda x: x.rlike(BULLET))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(ELLIPSIS))).cast("long").alias("n_ellipsis_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    keep = ["row", "n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"]
    window = F.expr("CASE WHEN n_words >= 5 THEN transform(slice(h, 1, CAST(n_words AS INT) - 4), (a, i) -> xxhash64(a, h[i + 1], h[i + 2], h[i + 3], h[i + 4])) ELSE CAST(array() AS ARRAY<BIGINT>) END")
    step = step.select(*keep, window.alias("win"))
    # only a text with an equal pair of windows needs the sort
    step = step.select(*keep, F.expr("CASE WHEN size(array_distinct(win)) < size(win) THEN sort_array(transform(win, (a, i) -> struct(a AS h, i AS i))) END").alias("s"))
    step = step.select(*keep, F.expr("sort_array(transform(filter(s, (x, k) -> coalesce(x.h = get(s, k - 1).h, false) OR coalesce(x.h = get(s, k + 1).h, false)), x -> x.i))").alias("p"))
    repeats = F.expr("CASE WHEN p IS NULL THEN 0L ELSE aggregate(transform(p, (x, k) -> coalesce(least(5, get(p, k + 1) - x), 5)), 0L, (a, x) -> a + x) END").alias("n_repeat_words")
    # a filter on the measurements would be moved to the scan with all of the above spelled out in it, over and over; one on what a generator makes stays above it
    return step.select(F.inline(F.array(F.struct(*keep, repeats))))


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """measure() and failed (long): bit i says that rule i of RULES failed."""
    bits = None
    for i, (_, fails) in enumerate(RULES):
        bit = F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, text, carry).withColumn("failed", bits).withColumn("rules_version", F.lit(RULES_VERSION))


def stored(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """ledger() as a written table, for several policies."""
    return scratch.table(ledger(docs, text, carry), "rule-ledger")


def apply(entries: DataFrame, policy: Policy) -> DataFrame:
    """entries with kept (boolean): no rule of the policy failed. Entries of another version of the rules have no verdict (null)."""
    return entries.withColumn("kept", F.when(F.col("rules_version") == RULES_VERSION, F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0))


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of the policy: texts that fail it, texts that fail it alone, texts kept by the policy without it."""
    masks = entries.select(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules])
    each = masks.select("m", "n", F.explode(rules).alias("r"))
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("m") == F.col("r.bit")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(total(hit).alias("n_failed"), total(rest).alias("n_only"), total(rest | (F.col("m") == 0)).alias("n_kept_without"))


def filter_documents(docs: DataFrame, policy: Policy = POLICIES["v1"], text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns."""
    kept = apply(ledger(docs, text), policy).where("kept")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    entries = stored(docs, carry=["doc_id"])
    verdict = apply(apply(entries, POLICIES["v2"]).withColumnRenamed("kept", "kept_v2"), POLICIES["v1"])
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"].mask).cast("long")) != 0
    return verdict.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed", "kept_v2")


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of two policies does to all documents, from one ledger."""
    entries = stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), carry=["doc_id"])
    return ablations(entries, POLICIES["v1"]).unionByName(ablations(entries, POLICIES["v2"]))


MEASURED_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT doc_id, id, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS BIGINT) AS n_letters,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  len(list_filter(l, lambda x: starts_with(ltrim(x, e' \t\x0b\x0c\r'), '-') OR regexp_matches(ltrim(x, e' \t\x0b\x0c\r'), '^[*+\x{2022}\x{2023}\x{25aa}\x{25cf}]'))) AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines FROM w),
p AS (SELECT id, unnest(generate_series(1, n_words - 4)) AS i, w FROM m WHERE n_words >= 5),
g AS (SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(w[i:i + 4], ' ')) AS c FROM p),
d AS (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS nx FROM g WHERE c > 1),
r AS (SELECT id, sum(least(5, coalesce(nx - i, 5))) AS n FROM d GROUP BY id),
f AS (SELECT m.*, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN r USING (id)),
b AS MATERIALIZED (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
  + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)
  + (CASE WHEN 10 * n_letters < 6 * word_chars THEN 64 ELSE 0 END) + (CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 128 ELSE 0 END) + (CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 256 ELSE 0 END) AS BIGINT) AS failed FROM f)
"""
ORACLE_SQL = MEASURED_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, failed & 63 = 0 AS kept, failed, failed = 0 AS kept_v2 FROM b"
ABLATIONS_SQL = MEASURED_SQL + """, rule(name, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32), ('few_letters', 64), ('bullet_lines', 128), ('ellipsis_lines', 256)),
policy(version, mask) AS (VALUES ('v1', 63), ('v2', 511))
SELECT version, name AS rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed & mask = bit) AS n_only, count(*) FILTER (WHERE failed & mask & ~bit = 0) AS n_kept_without
FROM policy JOIN rule ON mask & bit <> 0 CROSS JOIN b GROUP BY version, name"""
