"""Quality rules as a short-circuit cascade of native expressions (operator 2).

Each rule is a condition on a few statistics of the text. On a bounded random sample the cascade measures what the
statistics cost (warm, above an empty measurement, all in one job) and which texts each rule rejects. Rules are then
ordered greedily: next comes the one that rejects most of the sample's texts still undecided per second, where
statistics that an earlier rule needs cost nothing more. The cascade runs in that order, each rule on what the
rules before it left: dear statistics are only computed for undecided texts. A text is rejected if any rule rejects
it, so the order changes the cost and the rule that is named, never the verdict.

``quality_filter`` is a chain of filters. ``quality_report`` must state the base statistics of every text, so these
are made for all; the other rules and their statistics stand behind a guard and are evaluated while no rule before
has rejected the text.

Everything is DataFrame or SQL functions. Repeated 3-word windows are found per text without exploding it: window
hashes with their position in the low half are sorted as plain longs, neighbours with equal hash halves are
candidates, and only those are compared as strings.

Defined cases: a null text has no words and fails the length rule; an empty table gives an empty result; extra
columns pass through, but for those with the names of the report's results; repeated rows are judged each; very long
texts take n log n time and are left out of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import read

#: The sample that costs and selectivities are measured on: about so many rows, none longer than so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 100_000
#: A measurement counts so many copies of the sample, after as many to warm up.
COPIES = 4
_HIGH = "-4294967296L"  # the upper 32 bits


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over the statistics that ``needs`` names."""

    name: str
    needs: tuple[str, ...]
    rejects: str


#: The first two are the base rules that every profile has.
RULES = (
    Rule("too_short", ("words",), "_n_words < 50"),
    Rule("repeated_windows", ("words", "repeats"), "100 * _n_repeat_words > 50 * _n_words"),
    Rule("symbols", ("words", "symbols"), "100 * _n_symbols > 10 * _n_words"),
    Rule("repeated_lines", ("lines",), "100 * _n_dup_lines > 40 * _n_lines"),
    Rule("word_length", ("words",), "_word_chars > 12 * _n_words OR _word_chars < 2 * _n_words"),
    Rule("few_letters", ("words", "letters"), "100 * _n_letter_words < 50 * _n_words"),
    Rule("few_distinct", ("words", "distinct"), "_n_distinct * _n_distinct < _n_words"),
    Rule("ellipses", ("lines", "ellipses"), "_n_lines >= 5 AND 100 * _n_ellipses > 30 * _n_lines"),
    Rule("bullets", ("lines", "bullets"), "_n_lines >= 5 AND 100 * _n_bullets > 90 * _n_lines"),
    Rule("shouting", ("words", "capitals"), "100 * _n_capitals > 70 * _word_chars"),
)
BASE = frozenset({"too_short", "repeated_windows"})
#: Statistics that a report states of every text.
STATED = ("words", "symbols", "lines", "repeats")

#: How each group of statistics is made, as steps of (column, SQL) over ``_text`` and earlier columns.
STATISTICS: dict[str, tuple[tuple[tuple[str, str], ...], ...]] = {
    "words": (
        (("_words", r"array_remove(split(_text, '[\\x20\\x09-\\x0D]+', -1), '')"),),
        (("_n_words", "CAST(size(_words) AS BIGINT)"), ("_word_chars", "CAST(length(array_join(_words, '')) AS BIGINT)")),
    ),
    "symbols": ((("_n_symbols", "CAST(length(_text) - length(translate(_text, '#*$%&|<>', '')) AS BIGINT)"),),),
    "lines": (
        (("_lines", r"filter(split(_text, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"),),
        (("_n_lines", "CAST(size(_lines) AS BIGINT)"), ("_n_dup_lines", "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)")),
    ),
    "letters": ((("_n_letter_words", r"CAST(size(filter(_words, w -> w RLIKE '\\p{L}')) AS BIGINT)"),),),
    "distinct": ((("_n_distinct", "CAST(size(array_distinct(_words)) AS BIGINT)"),),),
    "ellipses": ((("_n_ellipses", r"CAST(size(filter(_lines, x -> x RLIKE '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z')) AS BIGINT)"),),),
    "bullets": ((("_n_bullets", r"CAST(size(filter(_lines, x -> x RLIKE '\\A[\\x20\\x09-\\x0D]*[•*–-]')) AS BIGINT)"),),),
    "capitals": ((("_n_capitals", "CAST(length(_text) - length(translate(_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT)"),),),
    "repeats": (
        (
            (
                "_sorted",
                "CASE WHEN size(_words) > 3 THEN sort_array(transform(sequence(0, size(_words) - 3), "
                f"i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & {_HIGH}) | CAST(i AS BIGINT))) "
                "ELSE CAST(array() AS ARRAY<BIGINT>) END",
            ),
        ),
        (
            (
                "_likely",
                f"filter(_sorted, (x, j) -> (j > 0 AND (x & {_HIGH}) = (_sorted[greatest(j - 1, 0)] & {_HIGH})) OR "
                f"(j < size(_sorted) - 1 AND (x & {_HIGH}) = (_sorted[least(j + 1, size(_sorted) - 1)] & {_HIGH})))",
            ),
        ),
        (
            (
                "_windows",
                "array_sort(transform(_likely, x -> struct(array_join(slice(_words, CAST(x & 4294967295L AS INT) + 1, 3), ' ') AS s, "
                "CAST(x & 4294967295L AS INT) AS p)))",
            ),
        ),
        (
            (
                "_repeated",
                "filter(_windows, (x, j) -> (j > 0 AND x.s = _windows[greatest(j - 1, 0)].s) OR "
                "(j < size(_windows) - 1 AND x.s = _windows[least(j + 1, size(_windows) - 1)].s))",
            ),
        ),
        (
            (
                "_n_repeat_words",
                "CAST(size(array_distinct(flatten(transform(_repeated, x -> array(x.p, x.p + 1, x.p + 2))))) AS BIGINT)",
            ),
        ),
    ),
}


def with_statistics(df: DataFrame, groups: tuple[str, ...], guard: str | None = None) -> DataFrame:
    """Add the statistics of these groups that ``df`` lacks; with a guard only for the rows for which it holds."""
    for group in groups:
        for step in STATISTICS[group]:
            new = {name: F.expr(sql if guard is None else f"CASE WHEN {guard} THEN {sql} END") for name, sql in step if name not in df.columns}
            if new:
                df = df.withColumns(new)
    return df


def _boxed(docs: DataFrame, text_col: str, without: tuple[str, ...] = ()) -> DataFrame:
    """The row as one struct beside its text, so that no column of ``docs`` can clash with a statistic."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in without))
    return docs.select(row.alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))


@dataclass(frozen=True)
class Placed:
    """A rule in its place: what it costs there, in seconds a thousand texts, and the share of the undecided it rejects."""

    rule: Rule
    cost: float
    rejects: float


def draw_sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """About ``sample_rows`` random texts of the whole table, as a table of one partition."""
    text = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    share = min(1.0, sample_rows / max(docs.count(), 1))
    drawn = text.sample(False, share, seed=2) if share < 1 else text
    taken = drawn.where(F.length("_text") <= SAMPLE_CHARS).collect()
    return docs.sparkSession.createDataFrame([(r[0],) for r in taken], "_text string").coalesce(1)


def measured_costs(sample: DataFrame, groups: dict[str, tuple[str, ...]]) -> dict[str, float]:
    """Seconds that each group of statistics takes beyond those it needs, over the sample; ``groups``: with what it needs.

    One job: a branch a group, each a task that goes over copies of the sample. At each row the clock is read after
    the statistics that the group needs and again after its own (each reading depends on a hash of them, so it cannot
    come before); the differences of the later copies are added up, by which time code is compiled."""
    if not groups:
        return {}

    def after(needs: tuple[str, ...]) -> str:
        last = [name for group in needs for name, _ in STATISTICS[group][-1]] or ["_text"]
        return f"xxhash64({', '.join(last)}) % 1 + CAST(java_method('java.lang.System', 'nanoTime') AS BIGINT)"

    branches = []
    for g, needs in groups.items():
        before = tuple(n for n in needs if n != g)
        many = sample.select("_text", F.explode(F.sequence(F.lit(1), F.lit(2 * COPIES))).alias("_copy")).coalesce(1)
        seen = with_statistics(many, before).withColumn("_begins", F.expr(after(before)))
        seen = with_statistics(seen, needs).withColumn("_ends", F.expr(after((g,))))
        spent = F.sum(F.when(F.col("_copy") > COPIES, F.col("_ends") - F.col("_begins")))
        branches.append(seen.agg(F.coalesce(spent, F.lit(0)).alias("spent")).select(F.lit(g).alias("g"), "spent"))
    return {r["g"]: r["spent"] / 1e9 for r in reduce(DataFrame.union, branches).collect()}


def placed(rules: tuple[Rule, ...], rejected: list[tuple[bool, ...]], costs: dict[str, float], made: tuple[str, ...] = ()) -> list[Placed]:
    """Rules in the order of rejections per cost, each counted on the texts that those before it left; ``rejected``:
    for each text of the sample the rules' verdicts; ``made``: statistics that are there anyway."""
    left, out, undecided, have = list(enumerate(rules)), [], rejected, set(made)
    thousand = max(len(rejected) * COPIES, 1) / 1000
    while left:

        def worth(item: tuple[int, Rule]) -> tuple:
            k, rule = item
            cost = sum(costs.get(g, 0.0) for g in rule.needs if g not in have) + 1e-4  # a condition is not free
            return -sum(r[k] for r in undecided) / cost, cost, rule.name

        best = min(left, key=worth)
        k, rule = best
        out.append(Placed(rule, worth(best)[1] / thousand, sum(r[k] for r in undecided) / max(len(undecided), 1)))
        undecided = [r for r in undecided if not r[k]]
        have.update(rule.needs)
        left.remove(best)
    return out


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, made: tuple[str, ...] = (), after: tuple[Rule, ...] = (), sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Placed]:
    """The rules in the order that a sample of ``docs`` suggests; ``made``: statistics that every text gets anyway;
    ``after``: rules that have decided before."""
    sample = draw_sample(docs, sample_rows, text_col)
    needed = {g: rule.needs for rule in rules for g in rule.needs[-1:] if g not in made}
    needed |= {g: rule.needs[: k + 1] for rule in rules for k, g in enumerate(rule.needs) if g not in made and g not in needed}
    judged = with_statistics(sample, tuple(dict.fromkeys(g for rule in (*after, *rules) for g in rule.needs)))
    verdicts = judged.select(*(F.coalesce(F.expr(rule.rejects), F.lit(False)) for rule in (*after, *rules))).collect()
    undecided = [tuple(r[len(after) :]) for r in verdicts if not any(r[: len(after)])]
    return placed(rules, undecided, measured_costs(sample, needed), made)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``; rules in the measured order."""
    df = _boxed(docs, text_col)
    for n, place in enumerate(order_rules(docs, rules, text_col=text_col)):
        # A condition that reads a non-deterministic column stays above it: pushed down, it would be put in the
        # place of the statistics and have them computed anew for each word.
        df = with_statistics(df, place.rule.needs).withColumn(f"_stay{n}", F.spark_partition_id())
        df = df.where(f"NOT coalesce({place.rule.rejects}, false) AND _stay{n} >= 0")
    return df.select("_row.*")


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the stated statistics, ``base_failed``, ``rejected_by`` (first rule of the cascade) and ``kept``.

    Columns with these names give way. The base rules come first, as their statistics are made for every text; the
    others follow in the measured order (or in ``order``) and look at undecided texts only.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    base = [r for r in rules if r.name in BASE]
    others = tuple(r for r in rules if r.name not in BASE)
    if order is None:
        order = [p.rule for p in order_rules(docs, others, STATED, tuple(base), text_col=text_col)]
    df = with_statistics(_boxed(docs, text_col, (*names, "base_failed", "rejected_by", "kept")), STATED)
    verdict = F.lit(None).cast("string")
    for rule in reversed(base):
        verdict = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(verdict)
    df = df.withColumn("_by0", verdict)
    for n, rule in enumerate(order):
        guard = f"_by{n} IS NULL"
        df = with_statistics(df, tuple(g for g in rule.needs if g not in STATED), guard)
        df = df.withColumn(f"_by{n + 1}", F.expr(f"CASE WHEN {guard} THEN CASE WHEN {rule.rejects} THEN '{rule.name}' END ELSE _by{n} END"))
    last = f"_by{len(order)}"
    return df.select(
        "_row.*",
        *(F.col(f"_{n}").alias(n) for n in names),
        F.col("_by0").isNotNull().alias("base_failed"),
        F.col(last).alias("rejected_by"),
        F.col(last).isNull().alias("kept"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    report = quality_report(read(spark, sf_dir, "documents", "doc_id", "text"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
s AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM s) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM r) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, ws, ls, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 40 * n_lines
    OR word_chars > 12 * n_words OR word_chars < 2 * n_words
    OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 50 * n_words
    OR len(list_distinct(ws)) * len(list_distinct(ws)) < n_words
    OR (n_lines >= 5 AND 100 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) > 30 * n_lines)
    OR (n_lines >= 5 AND 100 * len(list_filter(ls, lambda x: regexp_matches(x, '\A[\x20\x09-\x0D]*[•*–-]'))) > 90 * n_lines)
    OR 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 70 * word_chars) AS kept
FROM f
"""
