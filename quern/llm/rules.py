"""Quality rules: a threshold table compiled into one Spark projection, with no user functions.

The measures are built from the array of words.  Repeated three-word windows are found without shuffling: each window
becomes one long whose high bits are its hash and whose low bits are its position, as many as the text's length needs; after one primitive sort
equal windows are neighbours.  Neighbours of equal hash are compared word by word; should any of a text differ, its windows are sorted
themselves, so that counts are exact at every length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, word_array

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages in the corpus (English, German, French, Spanish): a parameter of the rules.
STOP_WORDS = (
    *("the of and to in is it for that with as on be at by this are was from or an not have".split()),
    *("der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split()),
    *("de la le et les des en un du une que est pour qui dans par au sur pas avec il ce".split()),
    *("el los y del se las por con no para su al lo como más pero sus le".split()),
)


@dataclass(frozen=True)
class Rule:
    """Keep a document if ``low <= measure <= high``; the measure is a column of :func:`measures`, or a ratio of two."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    per: str | None = None


#: The method's thresholds.
RULES = (
    Rule("mean_word_length", "word_chars", 2.5, 15.0, per="n_words"),
    Rule("symbol_to_word_ratio", "n_symbols", None, 0.30, per="n_words"),
    Rule("stop_words", "n_stop_words", 2.0, None),
    Rule("stop_word_ratio", "n_stop_words", 0.02, None, per="n_words"),
    Rule("duplicate_line_ratio", "n_dup_lines", None, 0.50, per="n_lines"),
)


def _run_cover(at: Column) -> Column:
    """How many positions the three-word windows that start at the sorted positions ``at`` cover."""
    gap = lambda x, i: F.when(i == F.size(at) - 1, 3).otherwise(F.least(F.lit(3), F.get(at, i + 1) - x))
    return F.aggregate(F.transform(at, gap), F.lit(0), lambda a, x: a + x)


def measures(docs: DataFrame, text: str = "text", ident: str = "doc_id", carry: bool = False) -> DataFrame:
    """Counts for each document: ``n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_stop_words``.

    A null or empty text has all counts 0.  Repeated rows are measured each.  Other columns are left out, or with ``carry`` kept
    as one struct ``row``, so that no names clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(ident).alias("doc_id"), *row, body.alias("_t"), word_array(body).alias("_w"))
    rows = rows.withColumn("_n", F.size("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    windows = F.sequence(F.lit(0), F.col("_n") - 3)
    word = lambda i: F.get(F.col("_w"), i)
    bits = F.col("_bits")
    packed = F.transform(
        windows,
        lambda i: F.call_function("shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), bits).bitwiseOR(i.cast("long")),
    )
    exact = F.transform(windows, lambda i: F.struct(F.slice(F.col("_w"), i + 1, 3).alias("w"), i.alias("p")))
    rows = rows.withColumn("_bits", F.length(F.bin(F.col("_n").cast("long")))).withColumns(
        {
            "_joined": F.array_join("_w", ""),
            "_lines": lines,
            "_packed": F.when(F.col("_n") > 3, F.sort_array(packed)),
            "_stop": F.size(F.filter("_w", lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))),
        }
    )
    p, e = F.col("_packed"), F.col("_exact")
    key = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: (x - F.call_function("shiftleft", key(x), bits)).cast("int")
    same = lambda x, j: F.coalesce(key(x) == key(F.get(p, j)), F.lit(False))
    texts = lambda x: F.slice("_w", place(x) + 1, 3)
    clash = F.size(F.filter(p, lambda x, i: same(x, i + 1) & (texts(x) != texts(F.get(p, i + 1)))))
    rows = rows.withColumn("_exact", F.when(clash > 0, F.sort_array(exact)))
    twin = F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1))
    like = lambda i, j: F.coalesce(F.get(e, i)["w"] == F.get(e, j)["w"], F.lit(False))
    twins = F.filter(e, lambda x, i: like(i, i - 1) | like(i, i + 1))
    at = F.when(e.isNotNull(), F.transform(twins, lambda x: x["p"])).otherwise(F.transform(twin, place))
    rows = rows.withColumn("_at", F.sort_array(at))
    long = lambda c: c.cast("long")
    # through a generator of one row: a filter on a measure is otherwise moved below the projections, into every use of them
    one = F.struct(
        "doc_id",
        *(["row"] if carry else []),
        long(F.col("_n")).alias("n_words"),
        long(F.length("_joined")).alias("word_chars"),
        long(F.regexp_count("_joined", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.coalesce(_run_cover(F.col("_at")), F.lit(0))).alias("n_repeat_words"),
        long(F.col("_stop")).alias("n_stop_words"),
    )
    return rows.select(F.inline(F.array(one)))


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """One boolean column for each rule; a ratio over 0 counts as passed, for the base rule handles empty texts."""
    out = {}
    for r in rules:
        value = F.col(r.measure).cast("double")
        if r.per:
            value = F.try_divide(value, F.col(r.per))
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (value >= r.low)
        if r.high is not None:
            ok = ok & (value <= r.high)
        out[r.name] = F.coalesce(ok, F.lit(True))
    return out


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed``, ``kept`` and one column for each rule."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdicts = compile_rules(rules)
    kept = ~base
    for ok in verdicts.values():
        kept = kept & ok
    return measured.withColumns({"base_failed": base, "kept": kept} | {f"ok_{k}": v for k, v in verdicts.items()})


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and all thresholds, with their columns."""
    return judge(measures(docs, carry=True), rules).where("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(measures(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op7_quality_rules": op7_quality_rules}

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLES = {
    "op7_quality_rules": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x),
p AS (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS s FROM c WHERE n > 1),
q AS (SELECT r, sum(s)::BIGINT AS s FROM p GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(q.s, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops
  FROM l LEFT JOIN q ON l.r = q.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars / n_words BETWEEN 2.5 AND 15 AND n_symbols / n_words <= 0.3 AND stops >= 2 AND stops / n_words >= 0.02
  AND n_dup_lines / n_lines <= 0.5 AS kept FROM m""",
}
